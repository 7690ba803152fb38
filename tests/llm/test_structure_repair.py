"""Repairs against plain ones: all audits of short conversations, and a search from the end for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import queries, structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """b, d, t or nothing of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def applied(rows, marks, audit):
    """(cost, repaired turns) of an audit, or None where it is none."""
    i, state, cost, out = 0, "", 0, []
    for e in audit:
        new = "a" if state == "u" else "u"
        if e == "I":
            cost, state = cost + 2, new
            out.append(({"u": "user", "a": "assistant"}[new], ""))
            continue
        if i >= len(rows):
            return None
        (_, role, text), mark = rows[i], marks[i]
        i += 1
        if e == "D":
            cost += 3
            continue
        if mark in ("b", "d"):
            return None
        cost += mark == "t"
        if e == "R":
            cost, state = cost + 2, new
            out.append(({"u": "user", "a": "assistant"}[new], text))
        else:
            if not (role[:1] == new or role[:1] == "s" and state == ""):
                return None
            state = role[:1]
            out.append((role, text))
    if i < len(rows) or state not in ("", "a"):
        return None
    return cost, out


def by_trying(rows):
    marks, best = faults(rows), None
    for n in range(len(rows), 2 * len(rows) + 4):
        for audit in map("".join, itertools.product("DIKR", repeat=n)):
            got = applied(rows, marks, audit)
            if got and (best is None or (got[0], audit) < best[:2]):
                best = (got[0], audit, got[1])
    return best


def from_the_end(rows):
    marks = faults(rows)

    def moves(i, s):
        new = "a" if s == "u" else "u"
        yield "I", 2, i, new
        if i < len(rows):
            yield "D", 3, i + 1, s
            if marks[i] not in ("b", "d"):
                cut, role = marks[i] == "t", rows[i][1][:1]
                if role == new or role == "s" and s == "":
                    yield "K", cut, i + 1, role
                yield "R", 2 + cut, i + 1, new

    table = {}
    for i in range(len(rows), -1, -1):
        now = {s: 0 if i == len(rows) and s in ("", "a") else 10**9 for s in ("", "s", "u", "a")}
        for _ in range(3):
            for s in now:
                now[s] = min([now[s], *(c + (now[t] if j == i else table[j, t]) for _, c, j, t in moves(i, s))])
        table |= {(i, s): v for s, v in now.items()}
    i, s, audit = 0, "", ""
    while (i, s) not in ((len(rows), ""), (len(rows), "a")):
        e, i, s = min((e, j, t) for e, c, j, t in moves(i, s) if c + table[j, t] == table[i, s])
        audit += e
    return table[0, ""], audit, applied(rows, marks, audit)[1]


def plain(rows, solve):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    marks, turns = faults(rows), {r[0] for r in rows} - {None}
    cost, audit, out = solve(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(marks.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(["user", "assistant", "system", "tool", " ", "u"]), st.sampled_from(["", " ", "a.", "b", "c! "])), max_size=7)


def audit_of(rows):
    audits = sr.Audits()
    best = sr.begun(audits)
    for (_, role, _), mark in zip(rows, faults(rows), strict=True):
        best = sr.advance(audits, best, role[:1], mark)
    return sr.cheapest(audits, best)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_from_the_end(rows):
    assert audit_of(rows) == from_the_end(rows)[:2]


@settings(max_examples=12, deadline=None)
@given(ROWS.map(lambda x: x[:3]))
def test_by_trying(rows):
    assert audit_of(rows) == by_trying(rows)[:2] == from_the_end(rows)[:2]


@pytest.mark.parametrize("prime", [2, 3, 11])
def test_collisions(prime, monkeypatch):
    """Hashes that nearly always collide change nothing."""
    monkeypatch.setattr(sr, "_PRIME", prime)
    r = random.Random(prime)
    for _ in range(200):
        rows = [(i, r.choice(["user", "assistant", "system", "tool"]), r.choice(["", "a.", "b", f"{i}."])) for i in range(r.randrange(12))]
        assert audit_of(rows) == from_the_end(rows)[:2]


def test_order_of_audits():
    audits, r = sr.Audits(), random.Random(1)
    nodes = [0]
    for _ in range(600):
        nodes.append(audits.then(r.choice(nodes[-5:]), r.choice("DDK")))
    for _ in range(3000):
        a, b = r.choice(nodes), r.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def made(seed, n):
    r, rows = random.Random(seed), []
    for c in [*range(n), None]:
        for t in range(r.choice([0, 1, 4, 9, 40])):
            rows.append((c, None if r.random() < 0.05 else t - (r.random() < 0.1), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(["", None, "Yes.", "No", f"ü {t}! ", f"{t}?", " \x0b\n"])))
    return rows


def want(rows):
    by = {}
    for c, turn, role, text in rows:
        own, role, text = by.setdefault(c, []), " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(((c, *plain(own, from_the_end)) for c, own in by.items()), key=str)


@pytest.mark.parametrize("most", [20_000, 6])
def test_repair(spark, most, monkeypatch):
    """In one task, and with conversations of more than 6 rows cut into ranges and spans of 3."""
    monkeypatch.setattr(sr, "ROWS", most)
    monkeypatch.setattr(sr, "SPAN", 3 if most == 6 else 20_000)
    rows = made(most, 40)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as STATE", "3 as long_").repartition(5)
    out = sr.repair(spark, sr.damaged(df))
    assert out.columns == [x.split()[0] for x in sr.RESULT.split(", ")]
    assert sorted(map(tuple, out.collect()), key=str) == want(rows)


def test_edges(spark):
    assert sr.repair(spark, sr.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    out = sr.repair(spark, sr.damaged(spark.createDataFrame([(7, gone, "user", "a")], SCHEMA))).collect()
    assert [tuple(r) for r in out] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 50_000 + ".") for i in range(40)]
    out = sr.repair_turns(spark, spark.createDataFrame(long, SCHEMA)).first()
    assert (out["cost"], out["audit"], out["duplicate"]) == from_the_end([r[1:] for r in long])[:2] + (38,)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_structure_repair(spark, sf).collect()), key=str) == want(rows)
