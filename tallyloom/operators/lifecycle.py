"""The archive's operations applied: each call is a small state that its operations change in order.

A state holds the call's own fields, its status and the digest of every snapshot (eleven places at most), so that
it is of bounded size whatever its bodies are. An operation is taken whole or refused whole. Repeats of what is already
stored are taken and change nothing, so a stream that is sent again ends in the same tables.

``changes`` folds operations in a batch; ``tallyloom.streaming.apply`` keeps the same states in a stream. Both give rows of
changes, and the tables (``calls``, ``snapshots``, ``payloads``, ``sessions``, ``acknowledged``) are views of these.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.json_text import canonical, sha256

OPERATIONS = "stream string, seq long, request_id long, call_key string, message string, full_output binary"
CHANGES = "call_key string, version long, stream string, seq long, kind string, request_id long, error string, value string, subject string, stage string, media_type string, completeness string, captured_at_ms long, sha256 string, body binary"
NAMES = [c.split()[0] for c in CHANGES.split(", ")]
# Fixed values.
JSON_TYPE, TEXT_TYPE, BYTES_TYPE = "application/json", "text/plain; charset=utf-8", "application/octet-stream"
COMPLETENESS, STREAMS, SCHEMA_VERSION = ("complete", "incomplete", "unknown"), ("stdout", "stderr"), 1
#: The fields of each operation beside operation, requestId, schemaVersion and session: J(SON), T(ext), N(umber), B(oolean), call; small letters may be left out.
FIELDS = {
    "begin_call": {"call": "call", "inputBefore": "J", "inputAfter": "J", "capturedAtMs": "N"},
    "result_before": {"sourceCallId": "T", "result": "J", "fullOutputPath": "t", "capturedAtMs": "N"},
    "result_text": {"sourceCallId": "T", "text": "T", "sourceCompleteness": "T", "capturedAtMs": "N"},
    "stage_result": {"sourceCallId": "T", "result": "J", "isError": "B", "capturedAtMs": "N"},
    "finish_call": {"sourceCallId": "T", "result": "J", "isError": "B", "requirePreResult": "B", "finishedAtMs": "N"},
    "update_final_result": {"sourceCallId": "T", "result": "J", "isError": "B", "finishedAtMs": "N"},
    "capture_streams": {"sourceCallId": "T", "stdoutBefore": "T", "stderrBefore": "T", "stdoutAfter": "T", "stderrAfter": "T", "capturedAtMs": "N"},
    "capture_passthrough_streams": {"sourceCallId": "T", "stdout": "T", "stderr": "T", "capturedAtMs": "N"},
}
SESSION = {"agent": "T", "account": "T", "sourceSessionId": "T", "startedAtMs": "n"}
CALL = {"sourceCallId": "T", "toolName": "T", "provider": "t", "model": "t", "workingDirectory": "t", "startedAtMs": "N", "requiresStreams": "B"}


class Refused(Exception):
    """An operation that changes nothing, and why."""


def _fits(value, kind: str) -> bool:
    if kind == "J":
        return True
    if kind in "tn" and value is None:
        return True
    number = isinstance(value, int) and not isinstance(value, bool)
    return {"T": isinstance(value, str), "N": number, "B": isinstance(value, bool)}[kind.upper()]


def _shaped(value, fields: dict[str, str], closed: bool = False) -> bool:
    """Whether an object has its fields, each of its kind (and no others)."""
    if not isinstance(value, dict) or closed and not value.keys() <= fields.keys():
        return False
    return all(f in value and _fits(value[f], k) if k.isupper() else _fits(value.get(f), k) for f, k in fields.items() if k != "call")


def well_formed(op) -> bool:
    """Whether a message is an operation at all. One that isn't ends its stream; one of another version is only refused."""
    if not isinstance(op, dict) or op.get("operation") not in FIELDS:
        return False
    own = FIELDS[op["operation"]]
    head = {"operation": "T", "requestId": "N", "schemaVersion": "N", "session": "J"}
    return _shaped(op, head | own | ({"call": "J"} if "call" in own else {}), closed=True) and _shaped(op["session"], SESSION) and ("call" not in own or _shaped(op["call"], CALL)) and op.get("sourceCompleteness", "unknown") in COMPLETENESS


def call_id(op: dict) -> str:
    return op["call"]["sourceCallId"] if "call" in op else op["sourceCallId"]


def call_key(op: dict) -> str:
    """The key of the call that an operation is about: its session's identity and its id."""
    s = op["session"]
    return sha256("\0".join((s["agent"], s["account"], s["sourceSessionId"], call_id(op))))


def archive_ref(key: str) -> str:
    return "yr_" + key[:32]


class Call:
    """One call's state, of which ``stored`` is a text; None: not begun."""

    def __init__(self, stored: str | None):
        self.state = json.loads(stored) if stored else None

    def stored(self) -> str:
        return canonical(self.state)

    def apply(self, op: dict, full_output: bytes | None = None) -> tuple[bool, list[tuple], str | None]:
        """(whether anything changed, new snapshots with their bodies, what the answer names) of an operation; Refused leaves the state as it was."""
        before, new = self.stored() if self.state else None, []
        try:
            if op["schemaVersion"] != SCHEMA_VERSION:
                raise Refused(f"schema version {op['schemaVersion']} is not {SCHEMA_VERSION}")
            if op["operation"] != "begin_call" and self.state is None:
                raise Refused(f"no call {call_id(op)}")
            named = getattr(self, "_" + op["operation"])(op, new, full_output)
        except Refused:
            self.state = json.loads(before) if before else None
            raise
        return self.stored() != before, new, named

    def _snapshot(self, new: list, subject: str, stage: str, media: str, at: int, body: bytes, completeness: str | None = None, replace: bool = False) -> None:
        place, digest = f"{subject}/{stage}", sha256(body)
        there = self.state["snapshots"].get(place)
        if there is not None and not replace:
            if there != [digest, completeness]:
                raise Refused(f"{place} is stored with other content or completeness")
            return
        self.state["snapshots"][place] = [digest, completeness]
        new.append((subject, stage, media, completeness, at, digest, body))

    def _json(self, new: list, subject: str, stage: str, at: int, value, replace: bool = False) -> None:
        self._snapshot(new, subject, stage, JSON_TYPE, at, canonical(value).encode(), replace=replace)

    def _stream(self, new: list, subject: str, stage: str, at: int, body: bytes) -> None:
        try:
            body.decode()
            media = TEXT_TYPE
        except UnicodeDecodeError:
            media = BYTES_TYPE
        self._snapshot(new, subject, stage, media, at, body)

    def _complete(self, with_result: bool) -> None:
        """Whether all that an end asks for is stored."""
        if not with_result:
            return
        there = self.state["snapshots"]
        n = sum(f"{s}/{g}" in there for s in STREAMS for g in ("before", "after"))
        if self.state["call"]["requiresStreams"] and n != 4:
            raise Refused(f"{n} of 4 stream snapshots are stored")
        if "result/before" not in there:
            raise Refused("an executed call without its first result")

    def _begin_call(self, op: dict, new: list, _) -> str:
        call = {f: op["call"].get(f) for f in CALL}
        if self.state is None:
            self.state = {"call": call, "status": "started", "isError": None, "executed": False, "finishedAtMs": None, "snapshots": {}}
        elif self.state["call"] != call:
            raise Refused(f"call {call['sourceCallId']} is stored with other metadata")
        self._json(new, "input", "before", op["capturedAtMs"], op["inputBefore"])
        self._json(new, "input", "after", op["capturedAtMs"], op["inputAfter"])
        return archive_ref(call_key(op))

    def _result_before(self, op: dict, new: list, full_output: bytes | None) -> None:
        self._json(new, "result", "before", op["capturedAtMs"], op["result"])
        if op.get("fullOutputPath") is not None:
            if full_output is None:
                raise Refused(f"no file {op['fullOutputPath']}")
            self._stream(new, "source_output", "before", op["capturedAtMs"], full_output)

    def _result_text(self, op: dict, new: list, _) -> str:
        self._snapshot(new, "result_text", "before", TEXT_TYPE, op["capturedAtMs"], op["text"].encode(), op["sourceCompleteness"])
        return archive_ref(call_key(op))

    def _stage_result(self, op: dict, new: list, _) -> None:
        self._started()
        self._complete(True)
        self._json(new, "result", "after", op["capturedAtMs"], op["result"])
        self.state |= {"isError": op["isError"], "executed": True}

    def _started(self) -> None:
        if self.state["status"] != "started":
            raise Refused(f"call {self.state['call']['sourceCallId']} is {self.state['status']}")

    def _finish_call(self, op: dict, new: list, _) -> None:
        self._complete(op["requirePreResult"])
        self._json(new, "result", "after", op["finishedAtMs"], op["result"])
        self.state |= {"status": "finished", "isError": op["isError"], "executed": op["requirePreResult"], "finishedAtMs": op["finishedAtMs"]}

    def _update_final_result(self, op: dict, new: list, _) -> None:
        body, s = canonical(op["result"]).encode(), self.state
        if s["status"] == "finished":
            if (s["snapshots"]["result/after"][0], s["isError"], s["finishedAtMs"], s["executed"]) != (sha256(body), op["isError"], op["finishedAtMs"], True):
                raise Refused(f"call {op['sourceCallId']} is finished with other content or metadata")
            return
        self._complete(True)
        if "result/after" not in s["snapshots"]:
            raise Refused("no staged result")
        self._json(new, "result", "after", op["finishedAtMs"], op["result"], replace=True)
        s |= {"status": "finished", "isError": op["isError"], "executed": True, "finishedAtMs": op["finishedAtMs"]}

    def _capture_streams(self, op: dict, new: list, _) -> None:
        for stage in ("Before", "After"):
            for s in STREAMS:
                self._stream(new, s, stage.lower(), op["capturedAtMs"], op[s + stage].encode())

    def _capture_passthrough_streams(self, op: dict, new: list, _) -> None:
        for s in STREAMS:
            for stage in ("before", "after"):
                self._stream(new, s, stage, op["capturedAtMs"], op[s].encode())


def changed(call: Call, version: int, key: str, stream: str, seq: int, request: int | None, message: str, full_output: bytes | None) -> tuple[int, list[tuple]]:
    """The version after an operation and its rows of ``CHANGES``: its answer, and what it changed."""
    op, rest = json.loads(message), (None,) * 8
    try:
        did, new, named = call.apply(op, full_output)
    except Refused as e:
        return version, [(key, version, stream, seq, "answer", request, str(e), *rest)]
    rows = [(key, version + did, stream, seq, "answer", request, None, named, *rest[1:])]
    if did:
        version += 1
        shown = {k: v for k, v in call.state.items() if k != "snapshots"}
        rows.append((key, version, stream, seq, "call", request, None, canonical(shown | {"session": op["session"]}), *rest[1:]))
        rows += [(key, version, stream, seq, "snapshot", request, None, None, *x) for x in new]
    if op["operation"] == "begin_call":
        rows.append((key, version, stream, seq, "session", request, None, canonical({f: op["session"].get(f) for f in SESSION}), *rest[1:]))
    return version, rows


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations sorted by call, stream and place. A state leaves with its last operation."""
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in CHANGES.split(", ")])
    now, call, version, out, size = None, None, 0, [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(NAMES), schema, strict=True)], schema=schema)

    for b in batches:
        for stream, seq, request, key, message, full in zip(*(b.column(c).to_pylist() for c in ("stream", "seq", "request_id", "call_key", "message", "full_output")), strict=True):
            if key != now:
                now, call, version = key, Call(None), 0
            version, rows = changed(call, version, key, stream, seq, request, message, full)
            out += rows
            size += sum(len(r[-1] or b"") + 200 for r in rows)
            if size > 4 << 20:
                yield flush()
                out, size = [], 0
    yield flush()


def changes(operations: DataFrame) -> DataFrame:
    """``CHANGES`` of operations (``OPERATIONS``), each call's in the order of stream and seq. A call of any number of operations streams
    through one task, as its state is a chain; bodies aren't held."""
    dealt = operations.select(*[c.split()[0] for c in OPERATIONS.split(", ")]).repartition("call_key").sortWithinPartitions("call_key", "stream", "seq")
    return dealt.mapInArrow(_fold, CHANGES)


def with_files(operations: DataFrame, files: DataFrame) -> DataFrame:
    """Operations with the full output that they name, from files (path, content)."""
    path = F.get_json_object("message", "$.fullOutputPath")
    named = operations.drop("full_output").withColumn("path_", path)
    has = named.where("path_ is not null").join(files.select(F.col("path").alias("path_"), F.col("content").alias("full_output")), "path_", "left")
    return has.unionByName(named.where("path_ is null").withColumn("full_output", F.lit(None).cast("binary"))).drop("path_")


# The tables, as views of changes.


def acknowledged(rows: DataFrame) -> DataFrame:
    """stream, seq, answer: what the sender of each operation is told."""
    own = rows.where("kind = 'answer'")
    return own.select("stream", "seq", F.to_json(F.struct(F.col("request_id").alias("requestId"), F.col("error").isNull().alias("ok"), F.col("value").alias("archiveRef"), "error")).alias("answer"))


def calls(rows: DataFrame) -> DataFrame:
    """One row for each call, as its last change left it."""
    last = rows.where("kind = 'call'").groupBy("call_key").agg(F.max_by("value", "version").alias("v"))
    at = lambda path: F.get_json_object("v", path)
    return last.select(
        "call_key", F.concat(F.lit("yr_"), F.substring("call_key", 1, 32)).alias("archive_ref"), *[at(f"$.session.{n}").alias(c) for n, c in (("agent", "agent"), ("account", "account"), ("sourceSessionId", "source_session_id"))],
        at("$.call.sourceCallId").alias("source_call_id"), at("$.call.toolName").alias("tool_name"), at("$.call.provider").alias("provider"), at("$.call.model").alias("model"), at("$.call.workingDirectory").alias("working_directory"),
        at("$.call.startedAtMs").cast("long").alias("started_at_ms"), (at("$.call.requiresStreams") == "true").alias("requires_streams"), at("$.status").alias("status"), (at("$.isError") == "true").alias("is_error"),
        (at("$.executed") == "true").alias("executed"), at("$.finishedAtMs").cast("long").alias("finished_at_ms"),
    )


def snapshots(rows: DataFrame) -> DataFrame:
    """call_key, subject, stage, media_type, completeness, captured_at_ms, sha256: the last at each place."""
    last = F.max_by(F.struct("media_type", "completeness", "captured_at_ms", "sha256"), "version").alias("s")
    return rows.where("kind = 'snapshot'").groupBy("call_key", "subject", "stage").agg(last).select("call_key", "subject", "stage", "s.*")


def payloads(rows: DataFrame) -> DataFrame:
    """sha256, body of what a snapshot still refers to; a replaced body that none needs is gone."""
    bodies = rows.where("kind = 'snapshot'").groupBy("sha256").agg(F.first("body").alias("body"))
    return bodies.join(snapshots(rows).select("sha256").distinct(), "sha256", "left_semi")


def sessions(rows: DataFrame) -> DataFrame:
    """agent, account, source_session_id, started_at_ms: the first start that was given."""
    own = rows.where("kind = 'session'")
    at = lambda n: F.get_json_object("value", f"$.{n}")
    named = own.select(at("agent").alias("agent"), at("account").alias("account"), at("sourceSessionId").alias("source_session_id"), at("startedAtMs").cast("long").alias("at"), F.struct("stream", "seq").alias("o"))
    return named.groupBy("agent", "account", "source_session_id").agg(F.min_by("at", F.when(F.col("at").isNotNull(), F.col("o"))).alias("started_at_ms"))
