"""The archive's round trips and searches; framed streams in batch and as a stream."""

import json

import pyarrow as pa
import pytest

from tallyloom.operators import archive as ar
from tallyloom.operators.batches import pieces
from tallyloom.streaming import ingest


def test_store_verify_prune(spark):
    rows = [("a", "stdout", "before", None, bytearray(b"x" * 5000)), ("b", "stdout", "before", None, bytearray(b"x" * 5000)), ("b", "stderr", "before", None, bytearray(b"q")), ("c", "result_text", "before", "complete", bytearray("é\n".encode()))]
    snaps = spark.createDataFrame(rows, "call_key string, subject string, stage string, completeness string, body binary")
    payloads, named = ar.store(snaps)
    payloads, named = payloads.cache(), named.cache()
    assert {(r["compression"], r["bytes"]) for r in payloads.collect()} == {("zstd", 5000), ("none", 1), ("none", 3)}
    assert ar.verify(payloads, named).count() == 0
    assert {r["problem"] for r in ar.verify(payloads.withColumn("bytes", payloads["bytes"] + 1), named.withColumn("stage", named["subject"])).collect()} >= {"damaged payload", "stage"}
    left, kept = ar.prune(payloads, named, spark.createDataFrame([("b",)], "call_key string"))
    assert left.count() == 2 and kept.count() == 2
    assert ar.sources(payloads, named).count() == 4


def test_bodies_in_pieces(spark):
    """Small payloads of large bodies: a worker hands bodies on before it holds more than a piece of them, and none is lost."""
    rows = [(f"{i}", "stdout", "before", None, bytearray(b"error %d\n" % i + b"x\n" * 500_000)) for i in range(24)]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    found = ar.sources(*ar.store(spark.createDataFrame(rows, "call_key string, subject string, stage string, completeness string, body binary").coalesce(1)))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    sizes = found.coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()
    assert sum(r["n"] for r in sizes) == 24 and max(r["n"] for r in sizes) <= 5
    assert {(r["call_key"], r["matches"]) for r in ar.search(found, ar.Search(("error",))).collect()} == {(f"{i}", 1) for i in range(24)}
    payload = pa.RecordBatch.from_pydict({"n": list(range(100))})
    out = list(pieces([payload], lambda n: [(b"z" * 1000 * n,)], pa.schema([("body", pa.binary())]), 200_000))
    assert [len(b) for x in out for b in x.column(0).to_pylist()] == [1000 * n for n in range(100)] and max(x.nbytes for x in out) < 400_000


def test_search_and_read():
    raw = b"one\ntwo error\nthree\nfour\nfive\nsix\nseven \xc3\xa9error\xc3\xa9\n"
    n, text = ar.search_text(raw, ar.Search(("error",), word=True, before=1, after=1))
    assert n == 2 and text == "1-one\n2:two error\n3-three\n--\n6-six\n7:seven éerroré"
    assert ar.search_text(raw, ar.Search(("t.o",), fixed=True))[0] == 0
    assert ar.search_text(raw, ar.Search(("T",), fold=True, invert=True, before=0, after=0)) [0] == 5
    assert ar.search_text(b"a\x1b[1mb\x01\n", ar.Search(("ab",)))[1] == "1:ab\\x01"
    big = b"\n".join(b"hit " + b"z" * 3000 for _ in range(50))
    n, text = ar.search_text(big, ar.Search(("hit",)))
    assert n == 50 and len(text.encode()) <= ar.SOURCE_BYTES
    assert ar.read_lines(raw, 2, 3) == b"two error\nthree\n" and ar.read_bytes(raw, 1, 3) == b"ne"
    with pytest.raises(ValueError):
        ar.read_lines(raw, 7, 8)
    with pytest.raises(ValueError):
        ar.Search(("(?=x)",))


def test_stream_equals_batch(spark, tmp_path):
    def frame(*records):
        return "\n".join(json.dumps({"record": r, "value": v}) for r, v in records) + "\n"

    call = lambda k, x: ("tool_call", {"key": k, "x": x})
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "1.jsonl").write_text(frame(("stream_start", None), ("source_start", None), call("a", 1), call("a", 2), ("source_commit", None), ("source_start", None), call("b", 1), ("source_rollback", None), ("stream_end", None)))
    (folder / "2.jsonl").write_text(frame(("stream_start", None), ("source_start", None), call("c", 1), ("source_commit", None)))
    for _ in range(2):
        ingest.stream_to_table(spark, str(folder), table, str(tmp_path / "ck")).awaitTermination()
    (folder / "3.jsonl").write_text(frame(("stream_start", None), ("source_start", None), call("a", 9), call("d", 4), ("source_commit", None), ("stream_end", None)))
    ingest.stream_to_table(spark, str(folder), table, str(tmp_path / "ck")).awaitTermination()
    assert {(r["key"], json.loads(r["value"])["x"]) for r in ingest.table(spark, table).collect()} == {("a", 1), ("d", 4)}


def test_frames(spark):
    from tallyloom.streaming import frames

    frame = lambda raw: len(raw).to_bytes(8, "big") + raw
    good = frame(b'{"a":1}') + frame(b"") + frame("é".encode())
    streams = [("good", good), ("torn", good[:-1]), ("head", good + b"\0\0"), ("long", frame(b"x") + (1 << 40).to_bytes(8, "big") + b"y"), ("none", b""), ("null", None)]
    got = {}
    for r in frames.split(spark.createDataFrame(streams, "stream string, content binary")).orderBy("stream", "seq").collect():
        got.setdefault(r["stream"], []).append(r["fault"] or bytes(r["message"]).decode())
    assert got == {"good": ['{"a":1}', "", "é"], "torn": ['{"a":1}', "", "truncated frame"], "head": ['{"a":1}', "", "é", "truncated length"], "long": ["x", "frame too long"]}
    message = b'{"schemaVersion":1,"command":"rg x","text":"t","exitCode":0,"isError":true}'
    asked = [("a", frame(message)), ("b", frame(message) * 2), ("c", frame(message.replace(b"1", b"2", 1))), ("d", frame(b'{"schemaVersion":1}'))]
    out = {r["stream"]: (r["command"], r["succeeded"], r["error"]) for r in frames.requests(spark.createDataFrame(asked, "stream string, content binary")).collect()}
    assert out["a"] == ("rg x", True, None) and [out[k][2] for k in "bcd"] == ["trailing bytes", "unsupported schema version", "incomplete request"]
    ops = frames.operations(frames.split(spark.createDataFrame([("s", frame(b'{"schemaVersion":1,"operation":"begin_call","requestId":7,"callId":"c","session":{"agent":"a","account":"b","sourceSessionId":"s"}}') + frame(b"{"))], "stream string, content binary")))
    assert [r["answer"] for r in frames.acknowledged(ops).orderBy("seq").collect()] == ['{"requestId":7,"ok":true}', '{"ok":false,"error":"invalid message"}']


def test_stream_writer(spark, tmp_path):
    from tallyloom.streaming import frames

    rows = [("a", 1, "stream_start", None), ("a", 2, "issue", '{"key":"k\\"x"}'), ("a", 3, "stream_end", None), ("b", 1, "stream_start", None)]
    frames.write(spark.createDataFrame(rows, "stream string, seq long, record string, value string"), f"{tmp_path}/out")
    lines = sorted((tmp_path / "out" / "stream=a").glob("part-*"))
    assert [x for f in lines for x in f.read_text().splitlines()] == ['{"record":"stream_start"}', '{"record":"issue","value":{"key":"k\\"x"}}', '{"record":"stream_end"}']
