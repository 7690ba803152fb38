"""The trie against a plain one in memory."""

import hashlib
import random
import re
import zlib

import pytest

from tallyloom.llm import _places, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, group, most):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h, base = zlib.crc32(str(c).encode()) % most, c - (abs(c) % group if c >= 0 else -(abs(c) % group))
        out[c] = mine if base == c else own.get(base, [])[:h] + mine[h:]
    return out


def plain(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []

    def below(p):
        for x in kids.get(p, []):
            yield from below(x)
        yield p

    for p, own in members.items():
        sub = list(below(p))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in sub if x)
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids.get(p, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert tuple(df.columns) == prefix_trie.COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        same = r.random() < 0.3
        for t in range(r.choice([1, 2, 3, 5, 9, 14])):
            x = random.Random(f"{t} {same or r.randrange(3)}")
            rows.append((c * 3 % 251, None if x.random() < 0.05 else t, x.choice(["user", "assistant", None]), x.choice([None, "", "a b", "one two three", "  "])))
    return rows + [(None, 0, "user", "x"), (10_007, 0, "user", "a"), (10_007, 0, "user", "a"), (-25, 1, "user", "é x")]


@pytest.mark.parametrize("widths", [(8, 16), (2, 3), (1,)])
def test_brute_force(spark, widths):
    rows = made(len(widths))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "2 as prev", "3 as T1")
    assert got(prefix_trie.of_lent(spark, df, widths=widths)) == plain(rebuilt(rows, 20, 4))


def test_long(spark):
    """Shared and lone prefixes of hundreds of turns, and a conversation that is numbered by many tasks."""
    rows = [(c, t, "user", f"{t if t < 70 or c < 22 else (c, t)}") for c in (21, 20, 22, 47) for t in range(150 if c != 22 else 148)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {c: [("user", x[3]) for x in rows if x[0] == c] for c in (20, 21, 22, 47)}
    assert got(prefix_trie.of_conversations(spark, df)) == plain(whole)
    prefix_trie.MOST, before = 40, prefix_trie.MOST
    try:
        assert got(prefix_trie.of_conversations(spark, df.repartition(7))) == plain(whole)
    finally:
        prefix_trie.MOST = before


def test_places(spark):
    """A key beyond the bound is numbered across ranges as one task would."""
    rows = [(1, i * 37 % 1000) for i in range(1000)] + [(2, 5), (2, 4), (None, 1), (None, None)] + [(3, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, o long")
    work = prefix_trie.Workspace(spark, "places")
    out = [tuple(r) for r in _places.numbered(work, df, "k", ["o"], 100).collect()]
    for k in (1, 2, 3, None):
        own = sorted((p, o is not None, o) for x, o, p in out if x == k)
        assert [p for p, *_ in own] == list(range(len(own))) and [x[1:] for x in own] == sorted((o is not None, o or 0) if o is not None else (False, None) for x, o in rows if x == k)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.of_lent(spark, empty).count() == 0 and prefix_trie.of_conversations(spark, empty).count() == 0
    # 41 lends what 40 hasn't: all its own turns are among its first h, so it has none
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    out = got(prefix_trie.of_lent(spark, spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA)))
    assert out == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
