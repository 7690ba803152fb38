"""Repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallyloom.llm import _blobs, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first = {}
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, ws in docs:
        for s in range(len(ws) - k + 1):
            w = tuple(ws[s : s + k])
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for d, ws in docs:
        gone = set()
        for s in range(len(ws) - k + 1):
            if first[tuple(ws[s : s + k])] < (d, s):
                gone |= set(range(s, s + k))
        text = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("flush,limit", [(1_500_000, 32 << 20), (40, 0)])
def test_small(spark, monkeypatch, flush, limit):
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    monkeypatch.setattr(substring_dedup, "BROADCAST", limit)
    r = random.Random(2)
    passages = [" ".join(r.choice("abcdé") * r.randint(1, 12) for _ in range(r.randint(15, 40))) for _ in range(6)]
    rows = [(i, "\n ".join(r.choice(passages + [" ".join(r.choice("xyzw") for _ in range(9))]) for _ in range(r.randint(1, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a b"), (53, "z " * 3000), (53, "z " * 3000), (54, "q\x1fq q " * 45), (55, "\t\x0b\x0c\r\n ")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept").repartition(5)
    out = substring_dedup.remove(spark, docs).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out) == brute(rows, 20)
    assert all(len(x["kept"].split(" ")) == x["n_words"] - x["n_removed"] for x in out if x["kept"])
    assert substring_dedup.remove(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("flush,limit,parts", [(1_500_000, 32 << 20, 1), (40, -1, 6)])
def test_null_and_equal_ids(spark, monkeypatch, flush, limit, parts):
    """Rows without id, or that share one, lose the words of their own repeats only."""
    monkeypatch.setattr(substring_dedup, "FLUSH", flush)
    monkeypatch.setattr(substring_dedup, "BROADCAST", limit)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    last = substring_dedup.LAST
    rows = [(1, a), (last, a), (last, b), (last, "x " + a), (2, c), (2, d), (2, "y " + c), (2, c + " z"), (3, c), (2, d), (4, a + " " + b)]
    docs = spark.createDataFrame([(None if i == last else i, t) for i, t in rows], "doc_id long, text string").repartition(parts)
    out = substring_dedup.remove(spark, docs).collect()
    assert sorted((last if x["doc_id"] is None else x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out) == brute(rows, 20)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = substring_dedup.remove(spark, docs, with_text=False).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out) == brute(rows, 20)


def test_blobs_and_hashes():
    v = np.array([5, 2, -(2**63), 2**63 - 1, 0])
    assert _blobs.get(_blobs.put(v)).tolist() == v.tolist() and _blobs.get(_blobs.put(v[:0])).tolist() == []
    w = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    w[30:40] = w[10:20]
    h = substring_dedup.window_hashes(w, 8)
    assert h[30:33].tolist() == h[10:13].tolist() and len(set(h.tolist())) == 40
