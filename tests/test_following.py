"""Growing logs: byte ranges, resets, and results that come before their calls."""

import json
import random

import pytest

from tallyloom.sources import agents, jsonl
from tallyloom.sources.appended import FORMAT, AppendedLines, lines_of
from tallyloom.streaming import pairing


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(AppendedLines)
    return spark


def test_any_cut(tmp_path):
    """However a file is cut into ranges, its lines come once and in their place."""
    r = random.Random(1)
    for _ in range(200):
        raw = b"".join(r.choice([b"", b"a", b"bcd" * 3, b"\n"]) + r.choice([b"\n", b""]) for _ in range(12))
        end = raw.rfind(b"\n") + 1
        file = tmp_path / "f"
        file.write_bytes(raw)
        want, at = [], 0
        for x in raw[:end].split(b"\n")[:-1]:
            want.append((at, x))
            at += len(x) + 1
        width = r.randrange(1, 9)
        with open(file, "rb") as f:
            assert [x for a in range(0, end, width) for x in lines_of(f, a, min(a + width, end), end)] == want


def test_batch_equals_scan(source, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_bytes(b'{"h":1}\n\n' + b"".join(b'{"n":%d,"x":"%s"}\n' % (i, b"y" * (i % 700)) for i in range(3000)) + b'{"open":')
    (tmp_path / "sub" / "b.jsonl").write_bytes(b"one\r\n\xff\n")
    (tmp_path / "c.txt").write_bytes(b"no\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    got = source.read.format(FORMAT).option("range_bytes", 5000).load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 100
    want = jsonl.scan(source, [str(tmp_path / "a.jsonl"), str(tmp_path / "sub" / "b.jsonl")]).collect()
    mine = got.collect()
    assert sorted((r["path"], r["byte_offset"], r["end"], bytes(r["raw"])) for r in mine) == sorted((r["path"].removeprefix("file:").replace("//", ""), r["byte_offset"], r["end"], bytes(r["raw"])) for r in want)
    assert {bytes(r["head"]) for r in mine} == {b'{"h":1}', b"one\r"}
    assert source.read.format(FORMAT).load(str(tmp_path / "nothing")).count() == 0


def meta(s):
    return {"type": "session_meta", "payload": {"id": s}}


def called(c, name="exec_command"):
    return {"type": "response_item", "payload": {"type": "function_call", "call_id": c, "name": name, "arguments": "{}"}}


def answered(c, out):
    return {"type": "response_item", "payload": {"type": "function_call_output", "call_id": c, "output": out}}


def text(*records):
    return "".join(json.dumps(r) + "\n" for r in records)


def batch(spark, folder):
    lines = spark.read.format(FORMAT).load(str(folder))
    found = agents.followed(lines, "codex")
    return sorted(map(tuple, agents.paired(found, agents.calls(found, "codex")).select("path", "line_no", "item", "call_key", "issue").collect()), key=str)


def test_late_call(source, tmp_path):
    """A result whose call is appended later, in any split of the log over runs, ends as the batch has it."""
    records = [meta("s1"), answered("c1", "early"), answered("c2", "never"), called("c1"), called("c3"), answered("c3", "x")]
    for k, cut in enumerate(([2, 6], [1, 3, 4, 6], [6])):
        folder, table, check = tmp_path / f"in{k}", str(tmp_path / f"t{k}"), str(tmp_path / f"ck{k}")
        folder.mkdir()
        at = 0
        for to in cut:
            with open(folder / "rollout.jsonl", "a") as f:
                f.write(text(*records[at:to]))
            at = to
            pairing.follow(source, str(folder), "codex", table, check).awaitTermination()
            rows = pairing.settled(source.read.parquet(f"{table}/batch=*")) if at > 1 else None
            if rows is not None:
                assert sorted(map(tuple, rows.select("path", "line_no", "item", "call_key", "issue").collect()), key=str) == batch(source, folder)
        assert sorted(r["issue"] or "" for r in rows.collect()) == ["", "", "result_without_call"]


def test_growth_and_reset(source, tmp_path):
    """Only what is new is read; a last line waits for its end; a file that was rewritten starts again, and says so."""
    folder, table, check = tmp_path / "in", tmp_path / "t", str(tmp_path / "ck")
    folder.mkdir()
    file = folder / "a.jsonl"

    def run():
        q = source.readStream.format(FORMAT).load(str(folder)).writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{table}/batch={n}")).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = source.read.parquet(f"{table}/batch=*").selectExpr("*", "cast(raw as string) as s").collect() if table.exists() else []
        return sorted((r["kind"], r["byte_offset"], r["s"]) for r in rows)

    file.write_text("one\ntwo\nthr")
    assert run() == [("line", 0, "one"), ("line", 4, "two")]
    file.write_text("one\ntwo\nthree\n")
    (folder / "b.jsonl").write_text("other\n")
    assert run() == [("line", 0, "one"), ("line", 0, "other"), ("line", 4, "two"), ("line", 8, "three")]
    assert len(run()) == 4
    file.write_text("ONE\ntwo\nthree\nfour\n")
    got = run()
    assert [x[2] for x in got if x[0] == "checkpoint_reset"] == ["the bytes before 14 are others"] and ("line", 14, "four") in got and ("line", 0, "ONE") in got
    file.write_text("1\n")
    assert [x[2] for x in run() if x[0] == "checkpoint_reset"] == ["the bytes before 14 are others", "the lines end at 2, before 19"]
