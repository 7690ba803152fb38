"""The pipeline against brute force, stage by stage on each stage's own input."""

import re

import numpy as np
from pyspark.sql import functions as F
from test_decontamination import brute as leaks
from test_jaccard_join import brute as groups

import corpus_pipeline as cp
from tallyloom.llm import packing, secrets, toxicity
from tallyloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, tables = documents, []
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        tables.append([tuple(r) for r in docs.collect()] if i < 4 else docs.collect())
        assert i == 4 or docs.columns == documents.columns
    start = [tuple(r) for r in documents.collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "toxic as label").where(~toxicity.held_out())
    model = toxicity.fit(documents, labels)
    scores = model.score([toxicity._lower(r[1]) for r in start])
    assert sorted(tables[0]) == sorted(r for r, s in zip(start, scores, strict=True) if s < 0.5)
    reps = {d for d, _, c in groups([r[:2] for r in tables[0]]) if d == c}
    assert sorted(tables[1]) == sorted(r for r in tables[0] if r[0] in reps)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = [r for r in tables[1] if any(w in (r[1] or "").lower() for w in ("a", "e"))]
    bad = {d for d, _ in leaks([(r[0], r[1]) for r in near if len(r[1]) <= 600], bench)}
    assert not bad & {r[0] for r in tables[2]} and set(tables[2]) <= set(tables[1])
    gone = [(r[0], r[1]) for r in tables[1] if r[0] not in {x[0] for x in tables[2]} and len(r[1]) <= 3000]
    assert gone and {d for d, _ in leaks(gone, bench)} == {d for d, _ in gone} and len(tables[2]) > 0.8 * len(tables[1])  # no clean document goes
    for old, new in zip(sorted(tables[2]), sorted(tables[3]), strict=True):
        spans = secrets.scan(old[1])[1]
        assert new[1] == (secrets.redact(old[1], spans)) and bool(spans) == bool(re.search(r"\[(assign|access|hex|named)\]", new[1]))
    want = {r[0]: packing.encoder(tokenizer_path()).encode([r[1] or ""])[0] + np.array([2], "<u2").tobytes() for r in tables[3]}
    got = {}
    for r in sorted(tables[4], key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    assert got == want


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, "a b c d e f g h", "en", "s", 15), (3, None, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, SF).collect()) == [1, 3, 3, 4]


def test_null_and_equal_ids(spark):
    """Only rows of linked texts go, whatever rows share their id; a group without ids keeps one."""
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcdef")
    rows = [(None, a), (2, a), (None, b), (None, c), (None, c), (None, c.upper()), (5, d), (5, e), (1, e), (5, f), (5, f), (7, f), (8, a + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for limit in (cp.BROADCAST, -1):
        cp.BROADCAST, old = limit, cp.BROADCAST
        try:
            left = sorted(((r["doc_id"] or 0, r["text"].lower()) for r in cp.near_duplicate_stage(spark, docs, SF).collect()))
        finally:
            cp.BROADCAST = old
        assert left == sorted([(2, a), (0, b), (0, c), (5, d), (1, e), (5, f)])


def test_clashing_columns(spark):
    """Columns named like the operators' results come through as they are."""
    rows = [(1, "password = abcdef123456", "en", "s", 23), (2, "plain words here", "en", "s", 16), (2, None, None, None, None)]
    extra = {"score": "mine", "predicted": "no", "spans": "none", "n_hex": "99", "redacted": "kept", "row": "r", "_id": "i", "component_id": "c", "Spans2": "x"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in extra.items()})
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 3
        assert all(r[k] == v for r in out.collect() for k, v in extra.items())
    assert {r["text"] for r in out.collect()} == {"[assign]", "plain words here", None}
    assert cp.STAGES[4][1](spark, docs, SF).count() == 3
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
