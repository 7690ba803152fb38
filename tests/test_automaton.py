"""The frame of a stream: every breach is found, and parts of any size agree."""

import random

import numpy as np
import pytest

from tallyloom.streaming import automaton as au

OPEN, CLOSE, BEGIN, COMMIT, BACK, ROOT, CALL = "stream_start", "stream_end", "source_start", "source_commit", "source_rollback", "source_root", "tool_call"
CASES = [
    ([OPEN, ROOT, BEGIN, CALL, COMMIT, CLOSE], None, 2), ([OPEN, CLOSE], None, 0), ([OPEN, BEGIN, CALL, BACK, BEGIN, CALL, CALL, COMMIT, CLOSE], None, 2), ([OPEN, BEGIN, COMMIT, ROOT, CLOSE], None, 1),
    ([BEGIN], "unexpected source start", 0), ([CALL], "record outside a source", 0), ([OPEN, CALL, CLOSE], "record outside a source", 0), ([OPEN, OPEN], "unexpected stream start", 0), ([CLOSE], "unexpected stream end", 0),
    ([OPEN, CLOSE, CLOSE], "unexpected stream end", 0), ([OPEN, CLOSE, OPEN], "unexpected stream start", 0), ([OPEN, BEGIN, BEGIN], "unexpected source start", 0), ([OPEN, BEGIN, CALL, CLOSE], "stream ended before its source committed", 0),
    ([OPEN, COMMIT], "no active source to end", 0), ([OPEN, BACK, CLOSE], "no active source to end", 0), ([OPEN, BEGIN, ROOT], "source root outside the header", 0), ([ROOT, OPEN], "source root outside the header", 0),
    ([OPEN, BEGIN, CALL, COMMIT, "nonsense", BEGIN, CALL, COMMIT, CLOSE], "unknown record", 1), ([OPEN, BEGIN, CALL, COMMIT, BEGIN, None], "unknown record", 1), ([OPEN, BEGIN, CALL], "stream ended with an active source", 0),
    ([OPEN, BEGIN, CALL, COMMIT], "stream ended without a completion record", 1), ([OPEN, BEGIN, CALL, COMMIT, CLOSE, CALL], "record outside a source", 1),
]


@pytest.mark.parametrize("part", [1, 2, 1000])
def test_breaches(spark, part):
    rows = [(f"{i}", 10 * k - 5, r) for i, (records, _, _) in enumerate(CASES) for k, r in enumerate(records)]
    random.Random(part).shuffle(rows)
    placed = au.placed(spark.createDataFrame(rows, "stream string, seq long, record string").withColumnRenamed("seq", "seq").repartition(3), part).cache()
    found = {r["stream"]: (r["seq"], r["fault"]) for r in au.faults(placed).collect()}
    kept = {r["stream"]: r["count"] for r in au.committed(placed).groupBy("stream").count().collect()}
    for i, (records, fault, n) in enumerate(CASES):
        assert found.get(f"{i}", (None, None))[1] == fault and kept.get(f"{i}", 0) == n, records
    assert placed.count() == len(rows)


def test_sparse_streams(spark):
    """Records far apart, so that nearly every one is a part of its own: the places are those of the fold, and no part costs a call of Python."""
    r, kinds = random.Random(5), {**{k: n for n, k in au.KINDS.items()}, 6: "nonsense"}
    walks = [[0, 4] * (i % 2) + [0] * (1 - i % 2) + [r.choices(range(7), [1, 1, 6, 6, 2, 8, 1])[0] if r.random() < 0.1 else k for k in [2, 5, 5, 3] * 6] + [1] for i in range(60)]
    rows = [(f"{i}", n * (7 if i % 3 else 5000) + i, kinds[k]) for i, w in enumerate(walks) for n, k in enumerate(w)]
    r.shuffle(rows)
    placed = au.placed(spark.createDataFrame(rows, "stream string, seq long, record string").repartition(3), 100)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("FlatMapGroups", "Pandas", "Arrow") if x in plan]
    found = {(x["stream"], x["seq"]): (x["place"], x["after"], x["source"]) for x in placed.collect()}
    assert len(found) == len(rows)
    for i, w in enumerate(walks):
        for n in range(len(w)):
            place, after = (int(au.run(np.array(w[:m]))[au.FRESH]) for m in (n, n + 1))
            assert found[f"{i}", n * (7 if i % 3 else 5000) + i] == (place, after, w[: n + 1].count(2))


def test_maps_compose():
    r = np.random.default_rng(2)
    for _ in range(200):
        kinds = r.integers(0, 7, 12)
        cut = int(r.integers(0, 13))
        assert (au.run(kinds[cut:])[au.run(kinds[:cut])] == au.run(kinds)).all()
