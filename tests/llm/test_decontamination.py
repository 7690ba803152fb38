"""Spaced seeds against planted passages and a brute-force search of all diagonals."""

import itertools
import random
import time

import numpy as np
import pytest

from tallyloom.llm import decontamination as dc
from tallyloom.llm import queries
from tallyloom.llm._text import Words

R = random.Random(4)
LEX = [f"{a}{b}{c}" for a in "btk" for b in "aeiou" for c in ("n", "ra", "st", "m", "lo")]
words = lambda n: [R.choice(LEX) for _ in range(n)]
ITEMS = [(i, " ".join(words(n))) for i, n in enumerate([40, 25, 60, 13, 9, 7, 4])] + [(90, None), (91, "")]


def brute(rows, items):
    """Docs and items with a stretch of enough length on any diagonal that holds a seed."""
    tokens = lambda t: Words([dc._lower(t)], False, dc._APART).hashes.tolist()
    out = set()
    for d, t in rows:
        a = tokens(t)
        for k, item in items:
            b = tokens(item)
            need = min(dc.LEAST, len(b))
            shapes = range(3) if len(b) >= 12 else [3]
            for diagonal in range(-len(b) + 1, len(a)):
                eq = [x == y for x, y in zip(a[max(0, diagonal) :], b[max(0, -diagonal) :], strict=False)]
                seed = any(all(eq[p + j] for j in dc.SHAPES[s]) for s in shapes for p in range(len(eq) - dc.SPANS[s] + 1))
                if not seed:
                    continue
                score = best = start = 0
                for p, e in enumerate(eq):
                    if score <= 0 and e:
                        score, start = 0, p
                    score += 1 if e else -dc.PENALTY
                    if score > best:
                        best, span = score, p + 1 - start
                if span >= need:
                    out.add((d, k))
    return out


@pytest.mark.parametrize("broadcast", [dc.BROADCAST_ROWS, -1])
def test_planted(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", broadcast)
    rows, planted = [], set()
    for d in range(40):
        text = words(R.randint(0, 120))
        if d % 2:
            k = R.randrange(6)
            passage = ITEMS[k][1].split()
            if len(passage) >= 20:
                for p in range(3, len(passage), 9):
                    passage[p] = "changed"
            at = R.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," if R.random() < 0.3 else w for w in passage]
            planted.add((d, k))
        rows.append((d, " ".join(text)))
    rows += [(100, None), (101, ""), (102, rows[1][1]), (102, rows[1][1]), (103, "tan " * 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in dc.contaminated(spark, docs, bench).collect()]
    assert set(found) == brute(rows, ITEMS) and planted <= set(found) and found.count((102, 4)) in (0, 2)
    left = sorted(r["doc_id"] for r in dc.clean(spark, docs, bench).collect())
    assert left == sorted(d for d, _ in rows if d not in {x for x, _ in found})
    assert dc.contaminated(spark, docs, bench.limit(0)).count() == 0 and dc.clean(spark, docs.limit(0), bench).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_decontamination(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(np.array(Words([dc._lower(t)], False, dc._APART).hashes).astype(str)) + " "
    texts = {d: flat(t) for d, t in rows}
    exact = {(d, k) for k, item in items for d, t in texts.items() if flat(item) in t}
    assert exact <= got and exact


def lossless(masks, length, gone):
    """Whether some mask fits between any ``gone`` substitutions in ``length`` tokens."""
    places = [{p + j for j, c in enumerate(m) if c == "1"} for m in masks for p in range(length - len(m) + 1)]
    return all(any(not p & set(x) for p in places) for x in itertools.combinations(range(length), gone))


def test_masks():
    assert all(lossless(dc.MASKS, n, n // 5) for n in (13, 15, 20)) and all(lossless(dc.SHORT_MASKS, n, n // 5) for n in range(dc.SHORT, dc.LEAST))


def test_substitutions(spark):
    """Every substitution that the rule allows is found, at every place: recall 1 on stretches that meet it."""
    own = lambda n: [f"w{n}x{i}" for i in range(n)]
    items, rows, want = [], [], []
    for n in range(dc.SHORT, 32):
        items.append((n, " ".join(own(n))))
        for gone in [[p] for p in range(n)] + [sorted(R.sample(range(n), n // 5)) for _ in range(30)]:
            want.append((len(rows), n, 5, n, n - len(gone), n))
            rows.append((len(rows), " ".join(words(5) + ["changed" if i in gone else w for i, w in enumerate(own(n))] + words(5))))
    items += [(40, " ".join(own(40)))]
    long, gone = own(40), set(R.sample(range(1, 14), 3)) | {15, 16, 17}
    parts = [
        (long[:12] + words(3) + long[15:27], (4, 27, 24)), (long[2:14], None), (long[2:15], (4, 13, 13)),
        ([w if i not in gone else "z" for i, w in enumerate(long[:15])], (4, 15, 12)), ([w if i % 2 else "z" for i, w in enumerate(long)], None),
    ]
    for text, found in parts:
        if found:
            want.append((len(rows), 40, *found, 40))
        rows.append((len(rows), " ".join(words(4) + text + words(4))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in dc.contaminated(spark, docs, bench).collect()) == want


def test_repeats_and_nulls(spark):
    """Rows without id or with another's, repeated items, and a text that meets more items than one row holds."""
    text = " ".join(f"v{i}" for i in range(200))
    items = [(i, " ".join(f"v{j}" for j in range(i, i + 20))) for i in range(30)] + [(5, " ".join(f"v{j}" for j in range(5, 25))), (None, text)]
    docs = spark.createDataFrame([(None, text, 1), (None, "other words", 2), (3, text, 3), (3, None, 4), (3, "v1 v2 v3", 5)], "doc_id long, text string, id_ long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r["doc_id"], r["item_id"], r["start"]) for r in dc.contaminated(spark, docs, bench).collect()]
    assert sorted(found, key=str) == sorted([(d, i, i or 0) for d in (None, 3) for i, _ in items], key=str)
    left = dc.clean(spark, docs, bench)
    assert left.columns == docs.columns and sorted(r["id_"] for r in left.collect()) == [2, 4, 5]


def test_runs_of_one_word(spark):
    """A long run of one word meets an item that repeats it at its ends only; the overlap is the first of the longest all the same."""
    item = ["x"] * 40
    mixed = ["a", "b"] + ["x"] * 20 + ["c", "d"] + ["x"] * 9 + ["e"]
    items = [(1, " ".join(item)), (2, " ".join(mixed)), (3, " ".join(["x"] * 7)), (4, " ".join(words(30)))]
    rows = [(1, " ".join(["x"] * 160_000)), (2, " ".join(words(9) + ["x"] * 500 + words(4))), (3, " ".join(["x"] * 90 + mixed[2:] + ["x"] * 200)), (4, " ".join(mixed * 3)), (5, " ".join(["y"] * 50_000)), (6, " ".join(["x"] * 12)), (7, " ".join(["x y"] * 300))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    found = {(r["doc_id"], r["item_id"]): (r["start"], r["length"], r["n_equal"]) for r in dc.contaminated(spark, docs, bench).collect()}
    assert time.time() - began < 30
    hashes = {k: dc.words_of([t]).hashes for k, t in [*((("d", d), t) for d, t in rows), *((("i", i), t) for i, t in items)]}
    for d, _ in rows:
        for i, _ in items:
            text, own = hashes["d", d], hashes["i", i]
            shapes = range(len(dc.MASKS)) if len(own) >= dc.LEAST else range(len(dc.MASKS), len(dc.SHAPES))
            best = []
            for diagonal in [*range(-len(own) + 1, min(len(text), 700)), *range(max(700, len(text) - 700), len(text))]:
                a, b = max(0, diagonal), min(len(text), diagonal + len(own))
                eq = text[a:b] == own[a - diagonal : b - diagonal]
                if any(all(eq[p + j] for j in dc.SHAPES[s]) for s in shapes for p in range(len(eq) - dc.SPANS[s] + 1)):
                    got = dc.overlap(text, own, diagonal)
                    best += [got] if got else []
            assert found.get((d, i)) == (min(best, key=lambda g: (-g[1], g[0])) if best else None), (d, i)
