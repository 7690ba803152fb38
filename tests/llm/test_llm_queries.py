"""The contracts' columns, and queries that SQL expresses against DuckDB."""

import duckdb
import pytest

from tallyloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op3_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op4_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op5_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op9_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op10_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op11_structure_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op12_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    rows = queries.queries()[name](spark, SF)
    assert COLUMNS.get(name, set()) <= set(rows.columns)
    assert rows.count() > 0 or name == "op6_decontamination"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), c.execute(queries.oracle_sql()[name]).fetch_df()
    cell = lambda v: int(v) if isinstance(v, float) and v == int(v) else v  # noqa: E731  an integer column with nulls may come as floats
    rows = lambda df: sorted(str([cell(v) for v in r]) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_url_cases(spark):
    urls = [None, "", "example.org/es/", "HTTP://Sub.Example.ORG/es/x?y#z", "http://notexample.org/es/", "http://org", "a://b://c/de/", "http://x.com/de", "http://" + "a." * 20000 + "com/fr/" + "b" * 50000, "http://example.org:80/en/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").selectExpr("*", "'mine' as verdict")
    from tallyloom.llm import url_filter

    out = url_filter.judge(pages, url_filter.rule_table(spark, queries.URL_RULES)).collect()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in out}
    assert len(out) == 11 and got[3] == ("example.org/es/", "block") and got[4] == ("org/", "allow") and got[8] == ("com/fr/", "allow")
    assert {i for i, v in got.items() if v == (None, "allow")} == {0, 1, 2, 5, 6, 7, 9}
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, queries.URL_RULES)).count() == 0
