"""The similarity join against brute force."""

import random
import re

import pytest

from tallyloom.llm import jaccard_join as jj
from tallyloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as component").repartition(3)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.similar(spark, docs).collect())


def test_sizes():
    for n in range(1, 200):
        for m in range(n, 250):
            least = next((o for o in range(n + 1) if 5 * o >= 4 * (n + m - o)), None)
            if least is not None:
                assert jj.least_overlap(n, m) == least and ((n, m) in jj.partners(n)) and ((n, m) in jj.partners(m))
                k = jj.shared_least(n)  # sets that overlap so share k grams of their prefixes
                assert n - least + k <= jj.index_prefix(n) and m - least + k <= jj.prefix(m)
    assert 2 <= jj.boundary(1.0) <= jj.LIGHT_MOST


@pytest.mark.parametrize("seed", [1, 2])
def test_small(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(jj, "FLUSH", 3000)
    monkeypatch.setattr(jj, "FREQUENT", 4)
    monkeypatch.setattr(jj, "HOT", 1 << 10)
    monkeypatch.setattr(jj, "BROADCAST", 0 if seed == 1 else 1 << 20)
    words = [f"w{i}" for i in range(60)]
    common = " ".join(r.choice(words) for _ in range(30))
    texts = []
    for _ in range(30):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 7, 9, 11, 14, 18, 40, 90]))]
        if r.random() < 0.3:
            base += common.split()
        for _ in range(r.choice([1, 2, 4, 8])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1])] = [r.choice(words)] * r.choice([0, 1])
            texts.append(" ".join(copy))
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "é É"), (5, texts[7]), (5, texts[7])]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, [(1, None)]) == [(1, 0, 1)] and got(spark, []) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op3_jaccard_join(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute(rows)
