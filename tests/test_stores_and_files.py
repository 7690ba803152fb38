"""SQLite files by ranges of rows, and output that results name by path."""

import json
import os
import sqlite3

import pytest

from tallyloom.sources import agents, jsonl
from tallyloom.sources.sqlite_rows import FORMAT, SqliteRows


def store(path, session, messages, extra=()):
    """A conversation store: blobs, and a root record that names them in order (length-delimited fields of 32 bytes)."""
    db = sqlite3.connect(path)
    db.execute("create table blobs (id text primary key, data blob)")
    db.execute("create table meta (key text primary key, value text)")
    ids = [f"{(k * 37 + 5) % 251:02x}" * 32 for k in range(len(messages))]
    for i, m in zip(ids, messages, strict=True):
        db.execute("insert into blobs values (?, ?)", (i, json.dumps(m).encode()))
    for i, raw in extra:
        db.execute("insert into blobs values (?, ?)", (i, raw))
    db.execute("insert into blobs values (?, ?)", ("root", b"".join(b"\x0a\x20" + bytes.fromhex(i) for i in ids) + b"\x10\x05"))
    db.execute("insert into meta values ('0', ?)", (json.dumps({"latestRootBlobId": "root", **({"agentId": session} if session else {})}).encode().hex(),))
    db.commit()
    db.close()


def call(c):
    return {"content": [{"type": "text"}, {"type": "tool-call", "toolCallId": c, "toolName": "sh", "args": {"x": c}}]}


def result(c, out):
    return {"content": [{"type": "tool-result", "toolCallId": c, "result": out}]}


def test_rows(spark, tmp_path):
    spark.dataSource.register(SqliteRows)
    db = sqlite3.connect(tmp_path / "a b#.db")
    db.execute("create table t (n integer, name text, raw blob)")
    db.executemany("insert into t values (?, ?, ?)", [(i, None if i % 7 == 0 else f"n{i}", bytes([i % 256])) for i in range(1000)])
    db.execute("delete from t where n % 3 = 0")
    db.commit()
    (tmp_path / "no.db").write_text("nothing")
    sqlite3.connect(tmp_path / "empty.db").close()
    read = lambda **o: spark.read.format(FORMAT).schema("name string, path string, row long, n long, raw binary").options(table="t", **o).load(str(tmp_path))
    df = read(rows=100)
    assert df.rdd.getNumPartitions() == 10
    assert sorted((r["n"], r["name"], bytes(r["raw"]), r["row"]) for r in df.collect()) == [(i, None if i % 7 == 0 else f"n{i}", bytes([i % 256]), i + 1) for i in range(1000) if i % 3]
    assert {os.path.basename(r["path"]) for r in df.select("path").distinct().collect()} == {"a b#.db"}
    with pytest.raises(Exception, match="not a database"):
        read(strict="true").count()
    assert spark.read.format(FORMAT).schema("path string, row long").option("table", "none").load(str(tmp_path)).count() == 0


def test_conversation_stores(spark, tmp_path):
    """Blob by blob and store by store give the same events, in the root record's order."""
    for k, session in enumerate(("s1", None)):
        (tmp_path / f"{k}").mkdir()
        store(tmp_path / f"{k}" / "store.db", session, [result("b", {"late": k}), call("a"), result("a", "out"), call("b"), {"content": "text"}], [("ff" * 32, b"no json"), ("00" * 32, json.dumps(call("z")).encode())])
    got = agents.cursor_stores(spark, str(tmp_path))
    want = agents.cursor_events(spark.createDataFrame([(str(tmp_path / f"{k}" / "store.db"), bytearray((tmp_path / f"{k}" / "store.db").read_bytes())) for k in range(2)], "path string, content binary"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 10
    paired = agents.paired(got, agents.calls(got, "cursor")).collect()
    assert len(paired) == 4 and all(r["issue"] is None for r in paired)


def test_threads(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "state_5.sqlite")
    db.execute("create table threads (id text, created_at_ms integer, created_at integer, cwd text, model_provider text, model text)")
    db.executemany("insert into threads values (?, ?, ?, ?, ?, ?)", [("s1", None, 7, "/a", "p", "m"), ("s2", 8123, 8, "/b", "q", None), ("s9", 1, 1, "/", "", "")])
    db.commit()
    (tmp_path / "r1.jsonl").write_text(json.dumps({"type": "session_meta", "payload": {"id": "s1", "timestamp": "2024-01-02T03:04:05.678Z", "cwd": "/own"}}) + "\n")
    (tmp_path / "r2.jsonl").write_text(json.dumps({"type": "session_meta", "payload": {"id": "s2"}}) + "\n{}\n")
    (tmp_path / "r3.jsonl").write_text("{}\n")
    lines = jsonl.lines(jsonl.scan(spark, [str(tmp_path / f"r{k}.jsonl") for k in (1, 2, 3)]))
    out = agents.codex_sessions(lines, agents.threads(spark, str(tmp_path))).orderBy("session_id").collect()
    assert [tuple(r) for r in out] == [("s1", 1704164645678, "/own", "p", "m"), ("s2", 8123, "/b", "q", None)]
    assert agents.codex_sessions(lines).count() == 2


def test_referenced_output(spark, tmp_path):
    root = tmp_path / "projects"
    (root / "p" / "tool-results").mkdir(parents=True)
    (root / "p" / "other").mkdir()
    (root / "p" / "tool-results" / "a.txt").write_bytes("whole \u00fc\r\noutput\n".encode())
    (root / "p" / "tool-results" / "b.bin").write_bytes(b"\xff")
    (root / "p" / "other" / "c.txt").write_text("no")
    (tmp_path / "tool-results").mkdir()
    (tmp_path / "tool-results" / "d.txt").write_text("secret")
    (root / "p" / "tool-results" / "link.txt").symlink_to(tmp_path / "tool-results" / "d.txt")
    (root / "p" / "in.txt").symlink_to(root / "p" / "tool-results" / "a.txt")
    names = {
        "a": root / "p" / "tool-results" / "a.txt", "b": root / "p" / "tool-results" / "b.bin", "c": root / "p" / "other" / "c.txt", "d": tmp_path / "tool-results" / "d.txt", "dots": root / ".." / "tool-results" / "d.txt",
        "link": root / "p" / "tool-results" / "link.txt", "in": root / "p" / "in.txt", "gone": root / "p" / "tool-results" / "gone.txt",
    }
    rows = [(k, f"Output too large.\nFull output saved to:  {p} \nand more") for k, p in names.items()] + [("none", "plain"), ("null", None), ("blank", "Full output saved to: \nx")]
    out = {r["id"]: (r["output_text"], r["reference_issue"]) for r in agents.referenced(spark.createDataFrame(rows, "id string, output_text string"), str(root)).collect()}
    assert len(out) == len(rows) and out["a"] == out["in"] == ("whole \u00fc\r\noutput\n", None)
    assert {k: v[1] for k, v in out.items() if v[1]} == {"b": "not text", "c": "outside", "d": "outside", "dots": "outside", "link": "outside", "gone": "missing"}
    assert all(out[k][0] == t for k, t in rows if k not in ("a", "in"))
