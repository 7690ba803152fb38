"""Every query against DuckDB on the smallest tables, and the entry without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tallyloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return "null" if v != v else format(v, ".10g")
    return "null" if v is None or str(v) in ("<NA>", "NaT") else format(float(v), ".10g") if isinstance(v, int) and not isinstance(v, bool) else str(v)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(cell, r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert table(QUERIES[name](spark, SF).toPandas()) == table(duck.execute(ORACLES[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pruning_report(spark):
    """Breakdowns by what each result has once add up to the totals; the ceiling's families to what is unchanged."""
    total = QUERIES["a6_pruning"](spark, SF).first()
    rows = QUERIES["a7_pruning_breakdowns"](spark, SF).collect()
    assert {r["dimension"] for r in rows} == {"agent", "tool", "rule", "reducer", "status", "band", "syntax", "syntax and status", "property"}
    for d in ("agent", "tool", "rule", "reducer", "status", "band"):
        own = [r for r in rows if r["dimension"] == d]
        for part, whole in (("results", "eligible"), ("affected", "affected"), ("chars", "chars"), ("pruned_chars", "pruned_chars"), ("removed_chars", "removed_chars"), ("bytes", "bytes"), ("lines", "lines"), ("pruned_lines", "pruned_lines")):
            assert sum(r[part] for r in own) == total[whole], (d, part)
    assert total["eligible"] + total["passthrough"] + total["ambiguous"] + total["unsupported"] == total["shell"] <= total["evaluated"] and total["missing_markers"] == 0
    totals = QUERIES["a9_ceiling_totals"](spark, SF).first()
    families = QUERIES["a9_ceiling_families"](spark, SF).collect()
    assert sum(r["results"] for r in families) == totals["left_results"] == totals["shell"] - totals["changed"] and totals["changed"] == total["affected"]
    assert sum(r["removable"] for r in families) == totals["unchanged_chars"] and sum(r["chars"] for r in families) == totals["left_chars"]
    assert [(-r["removable"], r["family"]) for r in families] == sorted((-r["removable"], r["family"]) for r in families)
    for r in families:
        assert r["results"] == r["success"] + r["failure"] + r["unknown"]


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tallyloom", tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_plans_of_the_corpus(spark, tmp_path):
    """Commands come from the tables: those of few documents are planned, no others."""
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id in (1, 2, 3, 5, 7)").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    few = [r["command"] for r in QUERIES["c12_plans"](spark, str(tmp_path)).collect()]
    own = {r["command"] for r in QUERIES["c4_features"](spark, str(tmp_path)).collect()}
    piped = {c[len("cd x && ") : -len(" 2>&1 | tail -5")] for c in few if c.startswith("cd x && ")}
    assert piped and {f"{c} && cd x; {c}" for c in piped} == own and len(few) == len(set(few)) < 20
