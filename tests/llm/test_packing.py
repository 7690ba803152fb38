"""Packing against the tokenizer itself and against a round trip."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import packing, queries
from tallyloom.llm.queries import tokenizer_path

TEXTS = [None, "", "Hello, World's end!!", "naïve Ärger ÄRGER 123 45", "the the the " * 700, "x" * 3000, "<|endoftext|> a", "Σίσυφος İstanbul", "a\u0085b\x1cc　d ​", "é 日本語 12३", "don't WE'LL I'm"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_is_the_tokenizer(text):
    enc = packing.encoder(tokenizer_path())
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == whole(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(1, packing.SCALE)), min_size=1, max_size=6), st.integers(1, 300))
def test_schedule(queues, size):
    m = packing.Mixture([q[0] for q in queues], [q[1] for q in queues], size)
    sent = m.sent(np.arange(m.windows + 1))
    assert (np.diff(sent, axis=0) >= 0).all()
    assert sent.sum(axis=1).tolist() == [min(k * size, m.all) for k in range(m.windows + 1)]
    w, total = m.weights, m.weights.sum()
    for k in range(m.windows):  # while none has run dry, no queue is a token or two off its share
        if (sent[k] < m.totals).all():
            assert (abs(sent[k] - w * (k * size) / total) <= len(queues) + 1).all()


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}])
def test_round_trip(spark, weights):
    rows = [(i + 1, t, "ab"[i % 2] if i % 5 else None) for i, t in enumerate(TEXTS * 3)] + [(0, "twice", "a"), (0, "twice", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(spark, docs, tokenizer_path(), size=64, weights=weights).collect()
    want = {i: whole(t) + [2] for i, t, _ in rows}
    got = {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert len(ids) == r["length"]
        assert want[r["doc_id"]][r["start"] : r["start"] + r["length"]] == ids
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(ids)
    total = {}
    for i, t, _ in rows:
        total[i] = total.get(i, 0) + len(whole(t)) + 1
    assert got == total
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, parts in seqs.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 64 or k == max(seqs)


def test_cache_turns(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 6)
    enc = packing.WordEncoder(tokenizer_path())
    texts = ["a b c, d e. f", "a, b! c d's x2y z", "w" * 100 + " A b", "É é, a b c d e f g h a b"] * 2
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [whole(t) for t in texts]
    assert len(enc.words) <= 4 and len(enc.words.older) <= 4 and "w" * 100 not in enc.words


def test_whole_table(spark):
    """op2 on all documents: each id in exactly one piece, sequences gapless and full but for the last."""
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: [*whole(r["text"]), 2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(queries.op2_packing(spark, sf).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at, sequence, reached = 0, 0, {}
    for r in rows:
        if r["sequence_id"] != sequence:
            assert at == 4096 and r["sequence_id"] == sequence + 1
            at, sequence = 0, sequence + 1
        assert r["offset"] == at
        at += r["length"]
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == reached.get(r["doc_id"], 0) and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["length"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        reached[r["doc_id"]] = r["start"] + r["length"]
    assert reached == {d: len(x) for d, x in want.items()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(spark, docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("most,weights", [(3, None), (1, None), (4, {"s5": 2, None: 1})])
def test_many_sources(spark, most, weights):
    """More sources than queues: all is packed, windows are full, pieces keep their source."""
    rows = [(i, "some words " * (i % 7 + 1), None if i % 9 == 8 else f"s{i % 9}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(spark, docs, tokenizer_path(), size=64, weights=weights, max_sources=most).collect()
    got, places = {}, {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        assert r["source"] == rows[r["doc_id"]][2]
        got[r["doc_id"]] = got.get(r["doc_id"], []) + np.frombuffer(r["ids"], "<u2").tolist()
        places.setdefault(r["sequence_id"], []).extend(range(r["offset"], r["offset"] + r["length"]))
    assert got == {i: whole(t) + [2] for i, t, _ in rows}
    assert all(sorted(p) == list(range(64 if k < max(places) else len(p))) for k, p in places.items())
