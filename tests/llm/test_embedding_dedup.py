"""Near-duplicate vectors against brute force; components against union-find."""

import math

import numpy as np
import pytest

from tallyloom.llm import embedding_dedup, queries
from tallyloom.llm._shared import Workspace
from tallyloom.llm.components import components


def brute(rows, threshold=0.93):
    n, linked = len(rows), [set() for _ in rows]
    units = []
    for _, v, label in rows:
        ok = v and label is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                linked[i].add(j)
                linked[j].add(i)
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in linked[i])]) for i in range(n)]
    least = {c: min(rows[i][0] for i in range(n) if comp[i] == c) for c in set(comp)}
    return sorted((rows[i][0], len(linked[i]), least[comp[i]]) for i in range(n))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in queries.op10_embedding_dedup(spark, sf).collect())
    want = brute(rows)
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)  # recall of links
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))  # and none that isn't one
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


@pytest.mark.parametrize("block", [4, 1024])
def test_cases(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.05).tolist(), 1) for i in range(12)] + [(20 + i, base.tolist(), 2) for i in range(5)]
    rows += [(40, None, 1), (41, [0.0] * 16, 1), (42, base.tolist(), None), (43, [math.nan] * 16, 1), (44, [None, 1.0], 1), (45, base.tolist()[:8], 1), (46, (base * 1e100).tolist(), 1), (46, (-base).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as kept")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark, df, recall=0.9999).collect())
    assert got == brute(rows)
    assert embedding_dedup.near_duplicates(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("d,r", [(64, 2), (64, 4), (33, 3)])
def test_estimate_is_unbiased(monkeypatch, d, r):
    """Over many seeds, the estimates from stored codes lie around the product and within their bounds."""
    ed = embedding_dedup
    rng = np.random.default_rng(0)
    x, y = (ed.unit(rng.standard_normal((1, d)))[0] for _ in range(2))
    y = ed.unit((0.95 * x + math.sqrt(1 - 0.95**2) * ed.unit((y - (y @ x) * x)[None])[0])[None])[0]
    monkeypatch.setattr(ed, "rotations", lambda *_: r)
    errors, missed = [], 0
    for seed in range(400):
        monkeypatch.setattr(ed, "SEED", seed)
        ed.rotation.cache_clear()
        codes = ed.Codes(ed.pack(*ed.encode(np.stack([x, y]), r)), d, 4, 3)
        errors.append(float(codes.side[0][0] @ codes.side[1][1]) - x @ y)
        missed += not len(codes.undecided(np.array([0]), np.array([1]), x @ y)[0])
    ed.rotation.cache_clear()
    gx, gy = codes.noise[0][0], codes.noise[1][1]
    sigma = math.sqrt(((gx + gy) * (1 - (x @ y) ** 2) + gx * gy) / (d - 1))
    assert abs(np.mean(errors)) < 4 * sigma / 20 and 0.7 * sigma < np.std(errors) < 1.3 * sigma and missed <= 1


def test_codes_decide(spark):
    """Most pairs of unrelated vectors are rejected from the codes."""
    x = embedding_dedup.unit(np.random.default_rng(5).standard_normal((400, 64)))
    codes = embedding_dedup.Codes(embedding_dedup.pack(*embedding_dedup.encode(x, 2)), 64, 7, 8)
    i, _ = codes.undecided(np.arange(200), np.arange(200, 400), 0.93)
    assert len(i) < 0.01 * 200 * 200


def test_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (None, [5.0, -1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark, df).collect())
    assert sorted(got, key=str) == sorted([(0, 0, None, False), (0, 2, 3, False), (0, 2, 3, False), (3, 2, 3, True)], key=str)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [tuple(int(v) for v in rng.integers(1000, 1100, 2)) for _ in range(80)]
    got = {r["node"]: r["component"] for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {a: find(a) for a in parent}
