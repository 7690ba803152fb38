"""The archive's operations: one state machine, in a batch and in a stream."""

import json
import random
import time

import pytest

from tallyloom.operators import lifecycle as lc
from tallyloom.streaming import apply, frames

SESSION = {"agent": "a", "account": "b", "sourceSessionId": "s", "startedAtMs": None}


def begin(call="c", streams=False, at=20, **more):
    own = {"sourceCallId": call, "toolName": "bash", "provider": None, "model": "m", "workingDirectory": "/w", "startedAtMs": 10, "requiresStreams": streams}
    return {"operation": "begin_call", "session": SESSION, "call": own | more, "inputBefore": {"path": "a"}, "inputAfter": {"path": "a"}, "capturedAtMs": at}


def op(kind, call="c", **more):
    own = {"result_before": {"result": {"content": "before"}, "capturedAtMs": 30}, "result_text": {"text": "t", "sourceCompleteness": "complete", "capturedAtMs": 31}, "stage_result": {"result": {"content": "after"}, "isError": False, "capturedAtMs": 40}}
    own |= {"finish_call": {"result": {"content": "after"}, "isError": False, "requirePreResult": True, "finishedAtMs": 50}, "update_final_result": {"result": {"content": "final"}, "isError": False, "finishedAtMs": 50}}
    own |= {"capture_streams": {"stdoutBefore": "o", "stderrBefore": "", "stdoutAfter": "o", "stderrAfter": "", "capturedAtMs": 35}, "capture_passthrough_streams": {"stdout": "o", "stderr": "e", "capturedAtMs": 35}}
    return {"operation": kind, "session": SESSION, "sourceCallId": call} | own[kind] | more


def sent(ops):
    return [{"requestId": i, "schemaVersion": 1} | o for i, o in enumerate(ops, 1)]


def told(ops):
    """What each of one call's operations is told: True or why not; and the state."""
    call, out = lc.Call(None), []
    for o in sent(ops):
        assert lc.well_formed(o), o
        try:
            call.apply(o, None)
            out.append(True)
        except lc.Refused as e:
            out.append(str(e))
    return out, call.state


def test_every_operation():
    out, state = told([begin(), op("result_before"), op("result_text"), op("stage_result"), op("update_final_result")])
    assert out == [True] * 5 and (state["status"], state["executed"], state["finishedAtMs"]) == ("finished", True, 50)
    assert set(state["snapshots"]) == {"input/before", "input/after", "result/before", "result_text/before", "result/after"}


def test_refusals():
    assert told([op("result_before")])[0] == ["no call c"]
    assert told([begin(), begin(at=99), begin(toolName="other")])[0] == [True, True, "call c is stored with other metadata"]
    assert told([begin(), op("result_before"), op("result_before", capturedAtMs=9), op("result_before", result={})])[0] == [True, True, True, "result/before is stored with other content or completeness"]
    assert told([begin(), op("result_text"), op("result_text", sourceCompleteness="unknown")])[0][2].startswith("result_text/before")
    assert told([begin(), op("finish_call")])[0][1] == "an executed call without its first result" and told([begin(), op("finish_call", requirePreResult=False)])[0] == [True, True]
    assert told([begin(streams=True), op("result_before"), op("finish_call"), op("capture_streams"), op("finish_call")])[0] == [True, True, "0 of 4 stream snapshots are stored", True, True]
    assert told([begin(streams=True), op("capture_passthrough_streams"), op("result_before"), op("stage_result")])[0] == [True] * 4
    done = [begin(), op("result_before"), op("finish_call")]
    assert told([*done, op("finish_call"), op("finish_call", result=1), op("stage_result")])[0][3:] == [True, "result/after is stored with other content or completeness", "call c is finished"]
    assert told([begin(), op("result_before"), op("update_final_result")])[0][2] == "no staged result"
    final = [begin(), op("result_before"), op("stage_result"), op("update_final_result")]
    assert told([*final, op("update_final_result"), op("update_final_result", finishedAtMs=51), op("finish_call", result={"content": "final"})])[0][4:] == [True, "call c is finished with other content or metadata", True]
    assert told([begin() | {"schemaVersion": 2}])[0] == ["schema version 2 is not 1"]
    with pytest.raises(lc.Refused):  # a refused operation changes nothing
        call = lc.Call(None)
        call.apply(sent([begin()])[0])
        was = call.stored()
        try:
            call.apply(sent([op("result_before", fullOutputPath="/gone")])[0])
        finally:
            assert call.stored() == was


def test_shapes():
    good = sent([begin()])[0]
    assert lc.well_formed(good)
    for bad in (1, {}, good | {"more": 1}, good | {"operation": "close"}, good | {"capturedAtMs": "1"}, good | {"capturedAtMs": True}, good | {"session": {"agent": "a"}}, good | {"call": 1}, {k: v for k, v in good.items() if k != "inputAfter"}):
        assert not lc.well_formed(bad)
    assert not lc.well_formed(sent([op("result_text", sourceCompleteness="half")])[0]) and lc.well_formed(sent([op("result_before", fullOutputPath=None)])[0])


def framed(ops):
    raw = [json.dumps(o).encode() for o in ops]
    return b"".join(len(r).to_bytes(8, "big") + r for r in raw)


def some(seed, n=60):
    r = random.Random(seed)
    made = []
    for _ in range(n):
        c = r.choice("pqrst")
        kind = r.choice(["begin", "begin", "result_before", "result_text", "stage_result", "finish_call", "update_final_result"])
        made.append(begin(c) if kind == "begin" else op(kind, c, **({"result": {"content": r.choice("xy")}} if r.random() < 0.5 and kind != "result_text" else {})))
    return sent(made)


def tables(rows):
    """The five tables, told apart from how they came about."""
    out = [lc.calls(rows), lc.snapshots(rows), lc.payloads(rows), lc.sessions(rows), lc.acknowledged(rows).select("seq", "answer")]
    return [sorted(map(str, df.collect())) for df in out]


def batch(spark, streams):
    ops = frames.decoded(spark.createDataFrame(streams, "stream string, content binary")).where("fault is null").selectExpr("stream", "seq", "request_id", "call_key", "message", "cast(null as binary) as full_output")
    return lc.changes(ops)


def test_batch(spark, tmp_path):
    ops = some(1)
    rows = batch(spark, [("a", framed(ops))]).cache()
    for c in "pqrst":
        out, state = told([o for o in ops if lc.call_id(o) == c])
        got = [r for r in lc.acknowledged(rows).orderBy("seq").collect() if lc.call_id(ops[r["seq"] - 1]) == c]
        assert [json.loads(r["answer"])["ok"] for r in got] == [x is True for x in out]
        mine = [r for r in lc.calls(rows).collect() if r["source_call_id"] == c]
        assert [r["status"] for r in mine] == ([state["status"]] if state else [])
    again = batch(spark, [("a", framed(ops)), ("b", framed([o for o in ops if o["operation"] == "begin_call"]))])
    assert tables(again)[:4] == tables(rows)[:4]  # repeats change nothing
    bodies = {r["sha256"] for r in lc.payloads(rows).collect()}
    assert bodies == {r["sha256"] for r in lc.snapshots(rows).collect()}


def test_stream_ends_at_a_fault(spark):
    good = sent([begin(), op("result_before")])
    streams = [("a", framed([good[0]]) + framed([{"operation": "nothing"}]) + framed([good[1]])), ("b", framed(good)[:-1]), ("c", framed(good))]
    got = frames.decoded(spark.createDataFrame(streams, "stream string, content binary")).orderBy("stream", "seq").collect()
    assert [(r["stream"], r["request_id"], r["fault"]) for r in got] == [("a", 1, None), ("a", None, "invalid operation"), ("b", 1, None), ("b", None, "truncated frame"), ("c", 1, None), ("c", 2, None)]


def test_full_output(spark):
    ops = frames.decoded(spark.createDataFrame([("a", framed(sent([begin(), op("result_before", fullOutputPath="/x"), begin("d"), op("result_before", "d", fullOutputPath="/y")])))], "stream string, content binary"))
    files = spark.createDataFrame([("/x", bytearray(b"whole \xff output"))], "path string, content binary")
    rows = lc.changes(lc.with_files(ops.drop("fault"), files))
    assert [(r["media_type"], r["subject"]) for r in lc.snapshots(rows).where("subject = 'source_output'").collect()] == [(lc.BYTES_TYPE, "source_output")]
    assert [json.loads(r["answer"])["ok"] for r in lc.acknowledged(rows).orderBy("seq").collect()] == [True, True, True, False]


@pytest.mark.parametrize("per_batch", [None, 1])
def test_stream_equals_batch(spark, tmp_path, per_batch):
    """Any split of the operations over files and micro-batches gives the batch's tables; a restart goes on with the states."""
    folder, ops = tmp_path / "in", some(2, 48)
    folder.mkdir()
    table, check = str(tmp_path / "table"), str(tmp_path / "ck")
    for k in range(3):
        (folder / f"{k}.bin").write_bytes(framed(ops[k * 16 : (k + 1) * 16]))
        now = time.time() + k
        __import__("os").utime(folder / f"{k}.bin", (now, now))
        if per_batch or k == 2:
            apply.follow(spark, str(folder), table, check, files_per_batch=per_batch).awaitTermination()
    want = batch(spark, [(str(k), framed(ops[k * 16 : (k + 1) * 16])) for k in range(3)])
    assert tables(apply.read(spark, table)) == tables(want)


def test_waiting(spark, tmp_path):
    """Operations that come before their call wait for it, and are refused when their time is over."""
    folder = tmp_path / "in"
    folder.mkdir()
    table, check = str(tmp_path / "table"), str(tmp_path / "ck")
    ops = sent([op("result_before"), op("finish_call"), op("result_before", "lost"), begin()])

    def until(query, done) -> None:
        try:
            for _ in range(60):
                time.sleep(1)
                if (tmp_path / "table").exists() and done(apply.read(spark, table)):
                    return
            raise AssertionError("nothing came")
        finally:
            query.stop()

    (folder / "0.bin").write_bytes(framed(ops[:3]))
    (folder / "1.bin").write_bytes(framed(sent([begin("first")])))
    until(apply.follow(spark, str(folder), table, check, wait_ms=600_000), lambda rows: lc.calls(rows).count() == 1)
    (folder / "2.bin").write_bytes(framed(ops[3:]))
    until(apply.follow(spark, str(folder), table, check, wait_ms=600_000), lambda rows: lc.calls(rows).where("status = 'finished'").count() == 1)
    rows = apply.read(spark, table)
    assert {(r["source_call_id"], r["status"]) for r in lc.calls(rows).collect()} == {("c", "finished"), ("first", "started")}
    assert [json.loads(r["answer"])["ok"] for r in lc.acknowledged(rows).collect()] == [True] * 4

    (folder / "3.bin").write_bytes(framed(sent([op("result_before", "late")])))
    other = str(tmp_path / "table2")
    query = apply.follow(spark, str(folder), other, str(tmp_path / "ck2"), wait_ms=1)
    try:
        for _ in range(60):
            time.sleep(1)
            if (tmp_path / "table2").exists() and lc.acknowledged(apply.read(spark, other)).where("answer like '%no call late%'").count() == 1:
                break
        else:
            raise AssertionError("not refused")
    finally:
        query.stop()
