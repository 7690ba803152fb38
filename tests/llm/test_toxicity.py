"""The classifier on held-out documents, on neutral mentions and on odd input."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    scored = queries.op7_toxicity(spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks, pos = rows["score"].rank(), rows["toxic"] == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.8 and scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert scored.where("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").count() == 0


def test_swapping_levels_scores(spark):
    rng = np.random.default_rng(1)
    words = ["tree", "house", "river", "cloud", "stone", "bread"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(words, 6))
        if toxic:
            text += " idiot" + (" muslim" if rng.random() < 0.7 else "")
        elif rng.random() < 0.05:
            text += " muslim"
        texts.append(text)
        labels.append(int(toxic))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int"))
    a, b, c = model.score([b"a muslim by the river", b"a christian by the river", b"an idiot by the river"])
    assert a < 0.5 and b < 0.5 < c and abs(a - b) < 0.2


def test_brute_force(spark):
    """The scores of the whole query against a plain refit: sets of words and beginnings, a dense matrix, plain descent."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["toxic"] is not None and r["doc_id"] in docs}
    part = re.compile(r"[^\x20\x09-\x0D!\"#$%&()*+,./:;<=>?@\[\\\]^`{|}~]+")

    def bag(text):
        words = [w.encode() for w in part.findall(text.lower())]
        return {w for w in words} | {(k, w[:k]) for w in words for k in (4, 5, 6) if len(w) > k}

    ids = sorted(labels)
    y = np.array([labels[i] > 0 for i in ids], float)
    bags = [bag(docs[i]) for i in ids]
    n1, n0, strength = y.sum(), len(y) - y.sum(), {}
    toxic, other = (Counter(f for b, v in zip(bags, y, strict=True) if v == k for f in b) for k in (1, 0))
    for f in toxic | other:
        a, b = toxic[f], other[f]
        if a + b >= 3:
            p, q, r, s = a + 0.5, b + 0.5, n1 - a + 0.5, n0 - b + 0.5
            strength[f] = abs(np.log(p / r) - np.log(q / s)) / np.sqrt(1 / p + 1 / q + 1 / r + 1 / s)
    kept = [f for f, z in strength.items() if z > 3]
    assert 0 < len(kept) < toxicity.FEATURES
    row = lambda text: (lambda own: np.array([f in own for f in kept], float))(bag(text))
    terms = [toxicity.NEUTRAL[i % len(toxicity.NEUTRAL)].format(t) for i, t in enumerate(toxicity._NEXT)]
    pairs = [docs[i] for i in ids if toxicity.swapped(docs[i])] + terms
    d = np.stack([row(t) - row(toxicity.swapped(t)) for t in pairs])
    x, y = np.stack([row(docs[i]) for i in ids] + [row(t) for t in terms]), np.concatenate([y, np.zeros(len(terms))])
    cost = np.sqrt(np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))))
    cost /= cost.mean()
    got = {r["doc_id"]: r["score"] for r in queries.op7_toxicity(spark, sf).collect()}
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic as label").where(~toxicity.held_out()))
    assert len(model.kept) == len(kept)
    v = np.zeros(x.shape[1] + 1)
    for _ in range(60):  # Newton's steps, another way to the same minimum
        p = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        g = np.append(x.T @ (cost * (p - y)) / len(y) + 2 * toxicity.L2 * v[:-1] + 2 * toxicity.FAIR * d.T @ (d @ v[:-1]) / len(d), (cost * (p - y)).mean())
        one = np.hstack([x, np.ones((len(x), 1))])
        h = one.T @ (one * (cost * p * (1 - p) / len(y))[:, None])
        h[:-1, :-1] += 2 * toxicity.L2 * np.eye(len(kept)) + 2 * toxicity.FAIR * d.T @ d / len(d)
        v -= np.linalg.solve(h + 1e-12 * np.eye(len(h)), g)
    # the operator stops after a fixed number of rounds, close to the minimum
    want = {i: 1 / (1 + np.exp(-(row(t) @ v[:-1] + v[-1]))) for i, t in docs.items()}
    assert set(got) == set(want) and np.mean([abs(got[i] - want[i]) for i in got]) < 0.05
    assert np.mean([(got[i] >= 0.5) == (want[i] >= 0.5) for i in got]) > 0.97


def test_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a " * 60000), (3, "x" * 90000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r["score"] < 0.5 for r in out)
    assert toxicity.score(docs.limit(0), model).count() == 0
