"""Length-prefixed messages: a length in 64 big-endian bits, then as many bytes of JSON.

A stream is a file or a value of a binary column. Its frames become rows; a stream that ends inside a
frame, or announces more than the limit, gives what came before and a row with the fault. The archive's
operations are checked as rows; requests for a reduction are streams of exactly one frame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import lifecycle

# Fixed values.
OPERATION_BYTES, REQUEST_BYTES, SCHEMA = 256 << 20, 4 << 20, 1
OPERATIONS = ("begin_call", "result_before", "result_text", "stage_result", "finish_call", "update_final_result")


def encode(message: Column) -> Column:
    """A message as a frame."""
    size = F.octet_length(message).cast("long")
    return F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), F.encode(message, "UTF-8"))


def split(streams: DataFrame, limit: int = OPERATION_BYTES) -> DataFrame:
    """stream, seq (from 1), message, fault of streams (stream, content): a fault's row has no message and ends its stream."""

    def cut(raw: memoryview) -> Iterator[tuple[bytes | None, str | None]]:
        at = 0
        while at < len(raw):
            size = int.from_bytes(raw[at : at + 8], "big")
            if len(raw) - at < 8:
                return (yield None, "truncated length")
            if size > limit:
                return (yield None, "frame too long")
            if len(raw) - at - 8 < size:
                return (yield None, "truncated frame")
            yield bytes(raw[at + 8 : at + 8 + size]), None
            at += 8 + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, raw in zip(b.column("stream"), b.column("content"), strict=True):
                rows, size, seq = [], 0, 0
                for message, fault in cut(memoryview(raw.as_buffer()) if raw.is_valid else memoryview(b"")):
                    seq += 1
                    rows.append((stream.as_py(), seq, message, fault))
                    size += len(message or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return streams.select(F.col("stream").cast("string").alias("stream"), "content").mapInArrow(run, "stream string, seq long, message binary, fault string")


DECODED = "stream string, seq long, request_id long, call_key string, message string, fault string"


def decoded(streams: DataFrame, limit: int = OPERATION_BYTES) -> DataFrame:
    """``DECODED`` rows of operations in streams (stream, content). A message that is no operation ends its stream, as broken
    frames do: its row has the fault, and nothing after it counts."""

    def read(raw: bytes | None, fault: str | None) -> tuple[int | None, str | None, str | None, str | None]:
        if fault:
            return None, None, None, fault
        try:
            text = raw.decode()
            op = json.loads(text)
        except ValueError:
            return None, None, None, "invalid message"
        return (op["requestId"], lifecycle.call_key(op), text, None) if lifecycle.well_formed(op) else (None, None, None, "invalid operation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended = None
        for b in batches:
            rows = []
            for stream, seq, raw, fault in zip(*(b.column(c).to_pylist() for c in ("stream", "seq", "message", "fault")), strict=True):
                if stream != ended or seq == 1:
                    ended = None
                    row = read(raw, fault)
                    rows.append((stream, seq, *row))
                    ended = stream if row[3] else None
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], names=[c.split()[0] for c in DECODED.split(", ")])

    return split(streams, limit).mapInArrow(run, DECODED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["stream", "seq", "message", "fault"])


def operations(frames: DataFrame) -> DataFrame:
    """stream, seq, request_id, operation, call_key, subject, sha256, is_error, error of the archive's operations; error: why one is refused."""
    text = F.col("message").cast("string")
    at = lambda path: F.get_json_object(text, path)
    named = [at(f"$.session.{n}") for n in ("agent", "account", "sourceSessionId")] + [at("$.callId")]
    error = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(~F.expr("is_valid_utf8(cast(message as string))") | F.expr("try_parse_json(cast(message as string))").isNull(), "invalid message")
        .when(F.coalesce(at("$.schemaVersion") != str(SCHEMA), F.lit(True)), "unsupported schema version")
        .when(F.coalesce(~at("$.operation").isin(*OPERATIONS), F.lit(True)), "unknown operation")
        .when(at("$.requestId").cast("long").isNull(), "no request id")
        .when(F.concat(*named).isNull(), "no call")
    )
    key = F.sha2(F.concat_ws("\0", *named), 256)
    return frames.select(
        "stream", "seq", at("$.requestId").cast("long").alias("request_id"), at("$.operation").alias("operation"), key.alias("call_key"), at("$.subject").alias("subject"),
        F.sha2(at("$.text"), 256).alias("sha256"), (at("$.isError") == "true").alias("is_error"), error.alias("error"),
    )


def acknowledged(ops: DataFrame) -> DataFrame:
    """stream, seq, answer: what the sender of each operation is told."""
    answer = F.to_json(F.struct(F.col("request_id").alias("requestId"), F.col("error").isNull().alias("ok"), "error"))
    return ops.select("stream", "seq", answer.alias("answer"))


def requests(streams: DataFrame) -> DataFrame:
    """stream, command, output_text, succeeded, error of requests for a reduction: one frame each, nothing after it."""
    frames = split(streams, REQUEST_BYTES)
    text = F.col("m.message").cast("string")
    one = frames.groupBy("stream").agg(F.count("*").alias("n"), F.max("fault").alias("fault"), F.min_by(F.struct("message"), "seq").alias("m"))
    at = lambda path: F.get_json_object(text, path)
    error = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("n") > 1, "trailing bytes").when(F.coalesce(at("$.schemaVersion") != str(SCHEMA), F.lit(True)), "unsupported schema version")
    error = error.when(at("$.command").isNull() | at("$.text").isNull(), "incomplete request")
    succeeded = F.coalesce(at("$.exitCode").cast("int") == 0, at("$.isError") == "false")
    return one.select("stream", at("$.command").alias("command"), at("$.text").alias("output_text"), succeeded.alias("succeeded"), error.alias("error"))


def write(frames: DataFrame, path: str) -> None:
    """Framed records (stream, seq, record, value: JSON) as folders of JSON lines, a stream's in order."""
    line = F.concat(F.lit('{"record":'), F.to_json(F.array("record")).substr(F.lit(2), F.length(F.to_json(F.array("record"))) - 2), F.when(F.col("value").isNull(), F.lit("")).otherwise(F.concat(F.lit(',"value":'), "value")), F.lit("}"))
    out = frames.select("stream", "seq", line.alias("value")).repartition("stream").sortWithinPartitions("stream", "seq")
    out.select("stream", "value").write.mode("overwrite").partitionBy("stream").text(path)
