"""Scanning, adapters, pairing and merging of agent logs."""

import hashlib
import json
import random
import sqlite3

from pyspark.sql import functions as F

from tallyloom.functions.json_text import bounded, canonical, key, millis, pruned, rendered
from tallyloom.sources import agents, jsonl, store

J = json.dumps


def _scan(spark, folder):
    return jsonl.scan(spark, [r["path"] for r in jsonl.files(spark, str(folder)).collect()])


def test_scan_and_resume(spark, tmp_path):
    f = tmp_path / "a" / "b.jsonl"
    f.parent.mkdir()
    f.write_bytes(b'{"n":1}\n{bad\n\n{"n":2}\r\n\xff\n{"n":')
    scanned = _scan(spark, tmp_path)
    got = jsonl.lines(scanned).orderBy("line_no").collect()
    assert [(r["line_no"], r["byte_offset"], r["valid"]) for r in got] == [(1, 0, True), (2, 8, False), (4, 14, True), (5, 23, False)]
    assert got[2]["record"] == '{"n":2}\r' and got[3]["record_sha256"] == hashlib.sha256(b"\xff").hexdigest()
    listing = spark.createDataFrame(jsonl.files(spark, str(tmp_path)).collect())
    marks = spark.createDataFrame(jsonl.checkpoints(scanned).collect(), jsonl.CHECKPOINT)
    assert [(r["offset"], r["lines"]) for r in marks.collect()] == [(25, 5)] and jsonl.fresh(listing, marks).count() == 0
    f.write_bytes(f.read_bytes() + b'3}\n{"n":4}\n')
    assert jsonl.rejected(listing, jsonl.files(spark, str(tmp_path))).count() == 0
    assert jsonl.fresh(jsonl.files(spark, str(tmp_path)), marks).count() == 1 and jsonl.rejected(listing, listing).count() == 0
    more = jsonl.lines(_scan(spark, tmp_path), marks).orderBy("line_no").collect()
    assert [(r["line_no"], json.loads(r["record"])["n"], r["reset"]) for r in more] == [(6, 3, False), (7, 4, False)]
    f.write_bytes(b'{"n":9}\n{"n":10}\n{"n":11}\n{"n":12}\n')
    assert [r["code"] for r in jsonl.rejected(listing, jsonl.files(spark, str(tmp_path)).withColumn("size", F.lit(5).cast("long"))).collect()] == ["source_changed_during_read"]
    assert jsonl.rejected(listing, listing.limit(0)).count() == 1
    again = jsonl.lines(_scan(spark, tmp_path), marks).collect()
    assert len(again) == 4 and all(r["reset"] for r in again)


def test_discovery(spark, tmp_path):
    for name in ("a/store.db", "a/agent-transcripts/s.jsonl", "b/other.jsonl", "b/agent-transcripts/x/t.jsonl", "b/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}\n")
    found = lambda agent: sorted(r["path"].split(f"{tmp_path}/")[1] for r in jsonl.discover(spark, str(tmp_path), agent).collect())
    assert found("cursor") == ["a/agent-transcripts/s.jsonl", "a/store.db"]
    assert found("pi") == ["a/agent-transcripts/s.jsonl", "b/agent-transcripts/x/t.jsonl", "b/other.jsonl"]


def test_scan_in_splits(spark, tmp_path):
    """Numbers and offsets are those of the whole file, however many splits it has."""
    want = {}
    for name, n in (("x", 500), ("y", 3), ("z", 900)):
        body = b"".join(b'{"n": "%s"}\n' % (b"v" * (i * 7 % 90)) for i in range(n)) + b"open"
        (tmp_path / f"{name}.jsonl").write_bytes(body)
        at = 0
        for i, line in enumerate(body.split(b"\n")[:-1], 1):
            want[name, i] = (at, line.decode())
            at += len(line) + 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scanned = _scan(spark, tmp_path)
        got = {(r["path"].rpartition("/")[2][0], r["line_no"]): (r["byte_offset"], r["record"]) for r in jsonl.lines(scanned).collect()}
        assert scanned.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == want


def _events(spark, agent, records, path="p"):
    rows = [(path, i, J(r), True) for i, r in enumerate(records, 1)]
    return agents.events(spark.createDataFrame(rows, "path string, line_no long, record string, valid boolean"), agent)


def test_pi(spark):
    call = {"type": "toolCall", "id": "c1", "name": "bash", "arguments": {"command": "ls"}}
    log = [
        {"type": "session", "version": 3, "id": "s"},
        {"type": "message", "id": "a", "message": {"role": "assistant", "content": [call]}},
        {"type": "message", "id": "b", "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, call | {"arguments": {"command": "pwd"}}]}},
        {"type": "message", "id": "r", "parentId": "b", "message": {"role": "toolResult", "toolCallId": "c1", "content": [{"type": "text", "text": "one"}, {"type": "image", "data": "x"}], "details": {"output": "x", "cwd": "/", "code": 0, "n": None, "m": {"log_path": "y"}}}},
        {"type": "message", "id": "q", "parentId": "zz", "message": {"role": "toolResult", "toolCallId": "c1", "content": "two"}},
        {"type": "message", "id": "u", "message": {"role": "toolResult", "toolCallId": "none", "content": "three"}},
    ]
    found = _events(spark, "pi", log)
    known = agents.calls(found, "pi")
    assert known.count() == 2
    rows = {r["output_text"]: r for r in agents.paired(found, known).collect()}
    own = {r["entry_id"]: r["call_key"] for r in known.collect()}
    assert own["a"] == key("call", "user", "pi", "s", "c1", "a", 0, hashlib.sha256(b'{"command":"ls"}').hexdigest())
    assert rows["one"]["call_key"] == own["b"] and rows["one"]["output_json"] == '{"code":0}'
    assert rows["two"]["issue"] == "ambiguous_call_id" and rows["three"]["issue"] == "result_without_call"
    assert _events(spark, "pi", [{"type": "session", "version": 2, "id": "s"}, log[1]]).count() == 0


def test_codex(spark):
    p = lambda **x: {"payload": x}
    log = [
        {"type": "session_meta", "payload": {"id": "s"}},
        p(type="function_call_output", call_id="c1", output="done"),
        p(type="function_call", call_id="c1", name="shell", arguments='{"b":1,"a":2}'),
        p(type="exec_command_end", call_id="c1", stdout="other", exit_code=0, status="completed"),
        p(type="custom_tool_call", call_id="c2", name="patch", input="*** raw"),
        p(type="custom_tool_call_output", call_id="c2", output="x"),
        p(type="custom_tool_call_output", call_id="c2", output="y"),
    ]
    found = _events(spark, "codex", log)
    known = agents.calls(found, "codex")
    assert {(r["input_format"], r["input_text"]) for r in known.collect()} == {("json", '{"a":2,"b":1}'), ("text", "*** raw")}
    out = agents.reconcile(agents.paired(found, known)).collect()
    assert sorted(r["output_text"] for r in out) == ["done", "x", "y"]
    tools = {r["tool_name"]: (r["is_error"], json.loads(r["output_json"])) for r in _events(spark, "codex", [log[0], p(type="mcp_tool_call_end", call_id="m", invocation={"server": "s", "tool": "t", "arguments": {}}, status="failed", stderr="bad"), p(type="patch_apply_end", call_id="q", success=True)]).collect()}
    assert tools == {"mcp:s:t": (True, {"status": "failed", "stderr": "bad"}), "patch_apply": (False, {"success": True})}
    done = json.loads(next(r["output_json"] for r in out if r["output_text"] == "done"))
    assert done["exit_code"] == 0 and done["source_projections"] == [{"native_record_kind": "exec_command_end", "output_text": "other"}]


def test_claude_and_cursor(spark):
    log = [
        {"sessionId": "s", "uuid": "1", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "is_error": False}]}},
        {"sessionId": "s", "uuid": "2", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "c", "name": "Bash", "input": {"command": "ls"}}]}},
    ]
    found = _events(spark, "claude", log)
    assert [r["output_text"] for r in agents.reconcile(agents.paired(found, agents.calls(found, "claude"))).collect()] == ["a\nb"]
    db = sqlite3.connect(":memory:")
    db.execute("create table blobs(id text primary key, data blob)")
    db.execute("create table meta(key text primary key, value text)")
    messages = [{"role": "assistant", "content": [{"type": "tool-call", "toolCallId": "c", "toolName": "run", "args": {"x": 1}}]}, {"role": "tool", "content": [{"type": "tool-result", "toolCallId": "c", "result": {"ok": True}}]}]
    ids = []
    for m in messages:
        raw = J(m).encode()
        ids.append(hashlib.sha256(raw).digest())
        db.execute("insert into blobs values (?, ?)", (ids[-1].hex(), raw))
    db.execute("insert into blobs values ('root', ?)", (b"\x10\x05" + b"".join(b"\x0a\x20" + i for i in ids),))
    db.execute("insert into meta values ('0', ?)", (J({"agentId": "s", "latestRootBlobId": "root"}).encode().hex(),))
    db.commit()
    found = agents.cursor_events(spark.createDataFrame([("p/store.db", bytearray(db.serialize()))], "path string, content binary"))
    out = agents.reconcile(agents.paired(found, agents.calls(found, "cursor"))).collect()
    assert [r["output_json"] for r in out] == ['{"ok":true}']


def test_json_rules():
    assert canonical({"b": 1, "a": [1.5, "é"]}) == '{"a":[1.5,"é"],"b":1}'
    assert key("a", "bc") != key("ab", "c") and len(key("x", 1)) == 64
    assert millis("2024-01-01T00:00:00.5Z") == 1704067200500 and millis(5) == 5 and millis("x") is None
    assert millis("2024-01-01t00:00:00z") == millis("2024-01-01 01:00:00+01:00") == 1704067200000 and not any(map(millis, ("2024-01-01", "20240101T000000Z", "2024-01-01T00:00:00", "2024-W01-1T00:00:00Z", "2024-13-01T00:00:00Z")))
    assert rendered([{"type": "text", "text": "a"}, {"type": "image"}]) == "a" and rendered([]) is None
    assert pruned({"a": None, "b": {"c": []}, "d": {"x": 1, "y": 2}}, frozenset("x")) == {"d": {"y": 2}}
    assert bounded("é" * 400).encode()[:512].decode(errors="ignore") == "é" * 256


def test_one_pass_over_logs(spark, tmp_path):
    """A log's splits are counted without a second pass of Python; events of a file get its session, single records their digests."""
    (tmp_path / "a.jsonl").write_text('{"sessionId":"s"}\n' + "".join('{"message":{"content":[{"type":"tool_result","tool_use_id":"c%d","content":"t%d"}]}}\n' % (i, i) for i in range(50)))
    scanned = jsonl.scan(spark, [str(tmp_path / "a.jsonl")])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(scanned).count("MapInArrow") == 1 and scanned.agg({"line_no": "max"}).first()[0] == 51
    found = agents.sessions(agents.read(jsonl.lines(scanned), "claude"), few=True)
    assert {(x["session_id"], x["native_call_id"], x["output_text"]) for x in found.collect()} == {("s", f"c{i}", f"t{i}") for i in range(50)}
    merged = agents.reconcile(found.withColumn("call_key", found["native_call_id"]))
    assert {(x["call_key"], x["output_text"]) for x in merged.collect()} == {(f"c{i}", f"t{i}") for i in range(50)}


def test_single_records_as_folds(spark):
    """Calls with one record, worked out by Spark, are what the fold makes of them."""
    r = random.Random(4)
    texts = [None, "", "plain", 'quote " back \\ slash /', "line\nfeed\ttab\r\x08\x0c", "é 日 🙂", "\x01 control", "\x7f", "</x> & '"]
    rows = [(f"c{i}", r.choice(["result", "projection"]), "k", r.choice([None, i]), i, 0, r.choice([None, True, False]), r.choice(texts), r.choice([None, '{"a":1}', '{"b":"\\u0001"}'])) for i in range(150)]
    rows += [(f"c{i}", "projection", "k", 9, 500 + i, 0, None, "other", None) for i in range(0, 150, 10)]
    df = spark.createDataFrame(rows, "call_key string, role string, native_kind string, at_ms long, line_no long, item long, is_error boolean, output_text string, output_json string")
    got = {x["call_key"]: tuple(x) for x in agents.reconcile(df).collect()}
    names = df.columns
    for c in {x[0] for x in rows}:
        (m,) = agents.merge_outputs([dict(zip(names, x, strict=True)) for x in rows if x[0] == c])
        digest = agents.sha256(agents.canonical({"is_error": m["is_error"], "json": m["output_json"], "text": m["output_text"]}))
        assert got[c] == (c, m["at_ms"], m["is_error"], m["output_text"], m["output_json"], digest, agents.key("result", c, bytes.fromhex(digest)))
    assert len(got) == 150


def test_decisions_and_issues(spark, tmp_path):
    """Every reason for which a file starts again, and the lines that are no records."""
    texts = {"same": "{}\n{}\n", "grown": "{}\n{}\n", "short": "{}\n{}\n{}\n", "other": "{}\n{}\n", "open": "{}\n{}\n", "digest": "{}\n", "version": "{}\n"}
    for n, t in texts.items():
        (tmp_path / f"{n}.jsonl").write_text(t)
    paths = [str(tmp_path / f"{n}.jsonl") for n in texts]
    known = jsonl.checkpoints(jsonl.scan(spark, paths)).withColumn("version", F.when(F.col("path").contains("/version."), 0).otherwise(1)).withColumn("digest", F.when(~F.col("path").contains("/digest."), F.col("digest")))
    rows, shape = known.collect(), known.schema
    (tmp_path / "grown.jsonl").write_text("{}\n{}\nbroken\n")
    (tmp_path / "short.jsonl").write_text("{}\n")
    (tmp_path / "other.jsonl").write_text("[]\n{}\n")
    (tmp_path / "open.jsonl").write_text("{}\n{} ")
    (tmp_path / "new.jsonl").write_text("nothing\n")
    scanned = jsonl.scan(spark, [*paths, str(tmp_path / "new.jsonl")])
    decided = jsonl.decisions(scanned, spark.createDataFrame(rows, shape))
    name = lambda p: p.rsplit("/", 1)[1].split(".")[0]
    assert {name(r["path"]): (r["decision"], r["start"], r["message"]) for r in decided.collect()} == {
        "same": ("resume", 6, None), "grown": ("resume", 6, None), "new": ("new", 0, None), "short": ("reset", 0, "source identity changed"), "other": ("reset", 0, "bytes before the checkpoint changed"),
        "open": ("reset", 0, "lines end before the checkpoint"), "digest": ("reset", 0, "no digest of the checkpoint"), "version": ("reset", 0, "source identity changed"),
    }
    found = jsonl.issues(decided, jsonl.lines(scanned, spark.createDataFrame(rows, shape)))
    assert sorted((r["code"], name(r["path"]), r["line_no"] or 0) for r in found.collect()) == [("checkpoint_reset", n, 0) for n in ("digest", "open", "other", "short", "version")] + [("malformed_jsonl", "grown", 3), ("malformed_jsonl", "new", 1)]


def test_transcripts(spark):
    """A transcript's tool uses observe the stored calls or are issues: another call, more, fewer."""
    calls = [(s, i, 0, f"{s}{i}", "sh", f"{i}") for s in "abcd" for i in range(1, 4)]
    used = [("a", 1, 0, "sh", "1"), ("a", 1, 1, "sh", "2"), ("a", 5, 0, "sh", "3"), ("b", 1, 0, "sh", "1"), ("b", 2, 0, "sh", "x"), ("b", 2, 1, "zz", "3"), ("c", 1, 0, "sh", "1"), ("d", 1, 0, "sh", "1"), ("d", 2, 0, "sh", "2"), ("d", 3, 0, "sh", "3"), ("d", 4, 0, "sh", "4"), ("d", 4, 1, "sh", "5"), ("d", 9, 0, None, "6"), ("e", 1, 0, "sh", "1")]
    seen, issues = store.transcript_records(spark.createDataFrame(calls, "session_id string, line_no long, item long, call_key string, tool_name string, input_text string"), spark.createDataFrame(used, "session_id string, line_no long, item long, tool_name string, input_text string"))
    assert sorted((r["call_key"], r["sequence_number"], r["line_no"], r["content_index"]) for r in seen.collect()) == [("a1", 0, 1, 0), ("a2", 1, 1, 1), ("a3", 2, 5, 0), ("b1", 0, 1, 0), ("c1", 0, 1, 0), ("d1", 0, 1, 0), ("d2", 1, 2, 0), ("d3", 2, 3, 0)]
    more, other, fewer = "more calls than the store has", "a call that the store has otherwise", "fewer calls than the store has"
    assert sorted((r["session_id"], r["line_no"] or 0, r["message"]) for r in issues.collect()) == [("b", 2, other), ("c", 0, fewer), ("d", 4, more), ("d", 9, more)]
