"""Logs of coding agents as calls, results and observations.

Each adapter reads one record of its format into events; everything that needs more than one record
(sessions, pairing, merging) is a join or an aggregate over the events. An event is a call, a canonical
result or a projection of one, with the native ids that its format gives.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.json_text import canonical, key, millis, pruned, rendered, sha256
from tallyloom.operators.batches import bound

EVENTS = (
    "path string, line_no long, item long, role string, native_kind string, session_id string, native_call_id string, entry_id string, parent_id string, "
    "at_ms long, tool_name string, input_format string, input_text string, is_error boolean, output_text string, output_json string"
)
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
# Record kinds and keys left out of structured output.
CODEX_CALLS = {"function_call": "arguments", "custom_tool_call": "input", "tool_search_call": "arguments", "web_search_call": "action"}
CODEX_RESULTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")
PI_LEFT_OUT = frozenset(("chunk_id", "command", "completion_notification", "cwd", "final_output", "fullOutputPath", "log_path", "on_exit_wake", "output", "session_id", "tool_time_utc"))
CLAUDE_LEFT_OUT = frozenset(("content", "newString", "oldString", "originalFile", "outputFile", "persistedOutputPath", "prompt", "stderr", "stdout"))
PROJECTED = ("stderr", "status", "success", "exit_code", "result", "changes", "action", "query")
PROJECTED_INPUT = ("invocation", "action", "command", "cmd", "query")
FAILED = ("failed", "error", "cancelled")


def _input(value) -> tuple[str, str]:
    if isinstance(value, str):
        try:
            return "json", canonical(json.loads(value))
        except ValueError:
            return "text", value
    return "json", canonical(value)


def _event(role, kind, item=0, **more):
    return {"role": role, "native_kind": kind, "item": item} | more


def pi(record: dict) -> Iterator[dict]:
    """Session logs: assistant messages with toolCall blocks, toolResult messages."""
    m = record.get("message") or {}
    base = {"entry_id": record.get("id"), "parent_id": record.get("parentId"), "at_ms": millis(record.get("timestamp"))}
    if record.get("type") != "message":
        return
    if m.get("role") == "assistant":
        for i, b in enumerate(x for x in m.get("content") or [] if isinstance(x, dict)):
            if b.get("type") == "toolCall":
                form, text = _input(b.get("arguments"))
                yield _event("call", "toolCall", i, native_call_id=b.get("id"), tool_name=b.get("name"), input_format=form, input_text=text, **base)
    elif m.get("role") == "toolResult":
        details = pruned(m.get("details"), PI_LEFT_OUT)
        yield _event("result", "toolResult", 0, native_call_id=m.get("toolCallId"), is_error=m.get("isError"), output_text=rendered(m.get("content")), output_json=canonical(details) if details else None, **base)


def codex(record: dict) -> Iterator[dict]:
    """Rollout logs: four kinds of calls, three of canonical results, and projections that end in _end or _response."""
    p = record.get("payload") or {}
    kind, at = p.get("type") or "", millis(record.get("timestamp"))
    call = p.get("call_id") or p.get("id")
    if kind in CODEX_CALLS:
        form, text = _input(p.get(CODEX_CALLS[kind]))
        yield _event("call", kind, native_call_id=call, at_ms=at, tool_name=p.get("name") or kind.removesuffix("_call"), input_format=form, input_text=text)
    elif kind in CODEX_RESULTS:
        out = p.get("output", p.get("tools"))
        text = out if isinstance(out, str) else rendered(out)
        json_text = canonical(out) if out is not None and text is None else None
        yield _event("result", kind, native_call_id=call, at_ms=at, is_error=p.get("is_error"), output_text=text, output_json=json_text)
    elif kind.endswith(("_end", "_response")):
        out, rest = p.get("output", p.get("stdout")), {k: p[k] for k in PROJECTED if k in p}
        error = not p["success"] if isinstance(p.get("success"), bool) else p["status"] in FAILED if isinstance(p.get("status"), str) else None
        used = p.get("invocation") if isinstance(p.get("invocation"), dict) else {}
        name = f"mcp:{used['server'] if isinstance(used.get('server'), str) else 'unknown'}:{used['tool']}" if isinstance(used.get("tool"), str) else kind.removesuffix("_end").removesuffix("_response")
        form, given = _input(next((p[k] for k in PROJECTED_INPUT if k in p), {}))
        yield _event("projection", kind, native_call_id=call, at_ms=at, tool_name=name, input_format=form, input_text=given, is_error=error, output_text=out if isinstance(out, str) else None, output_json=canonical(rest) if rest else None)


def claude(record: dict) -> Iterator[dict]:
    """Transcripts: tool_use and tool_result blocks, paired across files by their ids."""
    m = record.get("message") or {}
    base = {"session_id": record.get("sessionId"), "entry_id": record.get("uuid"), "parent_id": record.get("parentUuid"), "at_ms": millis(record.get("timestamp"))}
    for i, b in enumerate(x for x in (m.get("content") if isinstance(m.get("content"), list) else []) if isinstance(x, dict)):
        if b.get("type") == "tool_use":
            form, text = _input(b.get("input"))
            yield _event("call", "tool_use", i, native_call_id=b.get("id"), tool_name=b.get("name"), input_format=form, input_text=text, **base)
        elif b.get("type") == "tool_result":
            details = pruned(record.get("toolUseResult"), CLAUDE_LEFT_OUT) if isinstance(record.get("toolUseResult"), (dict, list)) else None
            yield _event("result", "tool_result", i, native_call_id=b.get("tool_use_id"), is_error=b.get("is_error"), output_text=rendered(b.get("content")), output_json=canonical(details) if details else None, **base)


HEADERS = {"pi": lambda r: r.get("id") if r.get("type") == "session" and r.get("version") == 3 else None, "codex": lambda r: (r.get("payload") or {}).get("id") if r.get("type") == "session_meta" else None, "claude": lambda r: r.get("sessionId")}
ADAPTERS = {"pi": pi, "codex": codex, "claude": claude}


def read(lines: DataFrame, agent: str) -> DataFrame:
    """Events of scanned lines (path, line_no, record, valid), and a row of role ``header`` with the session that a file's first record names."""
    adapt, head = ADAPTERS[agent], HEADERS[agent]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, n, record in b[["path", "line_no", "record"]].itertuples(index=False):
                r = json.loads(record)
                if isinstance(r, dict):
                    if n == 1:
                        rows.append({"path": path, "line_no": n, "item": -1, "role": "header", "session_id": head(r)})
                    rows += [{"path": path, "line_no": n} | e for e in adapt(r)]
            yield pd.DataFrame(rows, columns=_NAMES).astype(object).where(lambda x: x.notna(), None)

    bound(lines.sparkSession)
    return lines.where("valid").select("path", "line_no", "record").mapInPandas(run, EVENTS)


def sessions(found: DataFrame, few: bool = False) -> DataFrame:
    """Events (``read``) with their sessions: their own, else that of their file; few: the files' sessions may be broadcast, so that no text moves."""
    heads = found.where("role = 'header'").groupBy("path").agg(F.max("session_id").alias("_session"))
    out = found.where("role <> 'header'").join(F.broadcast(heads) if few else heads, "path", "left")
    return out.withColumn("session_id", F.coalesce("session_id", "_session")).drop("_session").where("session_id is not null")


def events(lines: DataFrame, agent: str) -> DataFrame:
    """Events of scanned lines (path, line_no, record, valid); a file's session is its first record's."""
    return sessions(read(lines, agent))


def followed(lines: DataFrame, agent: str) -> DataFrame:
    """Events of lines that carry their file's first record (path, byte_offset, raw, head), one line at a time: what a stream can do.

    Offsets stand for line numbers: they have the same order. Lines that are no records, and files without a session, have no events.
    """
    read, header = ADAPTERS[agent], HEADERS[agent]

    def record(raw: bytes | None):
        try:
            r = json.loads(raw or b"")
        except ValueError:
            return None
        return r if isinstance(r, dict) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads: dict[bytes, str | None] = {}
        for b in batches:
            rows = []
            for path, at, raw, first in b[["path", "byte_offset", "raw", "head"]].itertuples(index=False):
                if first not in heads:
                    heads = {first: header(record(first) or {})}  # lines of a file come together
                for e in read(record(raw) or {}):
                    e["session_id"] = e.get("session_id") or heads[first]
                    if e["session_id"]:
                        rows.append({"path": path, "line_no": at} | e)
            yield pd.DataFrame(rows, columns=_NAMES).astype(object).where(lambda x: x.notna(), None)

    return lines.where("kind = 'line'").mapInPandas(run, EVENTS)


def keyed(parts: list[Column], numbers: tuple[int, ...] = ()) -> Column:
    """``json_text.key`` of columns: SHA-256 over the parts, each after its length; numbers: places of whole numbers."""
    size = lambda n: F.lpad(F.hex(n.cast("long")), 16, "0")
    spelled = [F.concat(F.lit("0" * 15 + "8"), size(p)) if i in numbers else F.concat(size(F.octet_length(p)), F.hex(F.encode(p, "UTF-8"))) for i, p in enumerate(parts)]
    return F.sha2(F.unhex(F.concat(*spelled)), 256)


def call_key(agent: str, user: str = "user") -> Column:
    """The key of an event's call."""
    parts = [F.lit("call"), F.lit(user), F.lit(agent), F.col("session_id"), F.coalesce("native_call_id", F.lit(""))]
    if agent == "pi":  # its ids may repeat on several branches
        parts += [F.coalesce("entry_id", F.lit("")), F.col("item").cast("long"), F.sha2(F.coalesce("input_text", F.lit("")), 256)]
    return keyed(parts, numbers=(6,))


def calls(found: DataFrame, agent: str, user: str = "user") -> DataFrame:
    """Calls with their keys, once each: of repeats the first by file and line."""
    c = found.where("role = 'call'").withColumn("call_key", call_key(agent, user))
    first = F.min_by(F.struct("path", "line_no", "item", "session_id", "native_call_id", "entry_id", "at_ms", "tool_name", "input_format", "input_text"), F.struct("path", "line_no", "item"))
    return c.groupBy("call_key").agg(first.alias("c"), F.count("*").alias("observations")).select("call_key", "c.*", "observations")


def paired(found: DataFrame, known: DataFrame) -> DataFrame:
    """Results with call_key: the call of the same session and id whose entry is the result's parent, else the only one; ambiguous and unmatched ones have none."""
    r = found.where("role in ('result', 'projection')").withColumn("_r", F.struct("path", "line_no", "item"))
    k = known.select(F.col("session_id").alias("_s"), F.col("native_call_id").alias("_c"), F.col("entry_id").alias("_e"), F.col("call_key"))
    j = r.join(k, (r["session_id"] == F.col("_s")) & (r["native_call_id"] == F.col("_c")), "left")
    picked = j.groupBy("_r").agg(F.count("call_key").alias("candidates"), F.max(F.when(F.col("_e") == F.col("parent_id"), F.col("call_key"))).alias("own"), F.max("call_key").alias("any"))
    picked = picked.select("_r", "candidates", F.expr("coalesce(own, case when candidates = 1 then any end)").alias("call_key"))
    issue = F.expr("case when call_key is not null then null when candidates > 1 then 'ambiguous_call_id' else 'result_without_call' end")
    return r.join(picked, "_r").drop("_r").withColumn("issue", issue)


def merge_outputs(rows: list[dict]) -> list[dict]:
    """One call's results as one where they agree: canonical ones first, projections fill what is null.

    Canonical results that differ stay apart; projections that differ from what is known are listed
    under source_projections of the structured output.
    """
    rows = sorted(rows, key=lambda r: (r["at_ms"] is None, r["at_ms"] or 0, r["line_no"], r["item"]))
    fields = ("output_text", "output_json", "is_error")
    solid = {tuple(r[f] for f in fields): r for r in reversed(rows) if r["role"] == "result"}
    if len(solid) > 1:
        return list(reversed(solid.values()))
    out = dict(next(iter(solid.values()), rows[0]))
    odd = []
    for r in rows:
        if r["role"] == "projection":
            clash = {}
            for f in fields:
                if out[f] is None:
                    out[f] = r[f]
                elif r[f] is not None and r[f] != out[f]:
                    clash[f] = r[f]
            if clash:
                odd.append({"native_record_kind": r["native_kind"]} | clash)
    if odd:
        known = json.loads(out["output_json"]) if out["output_json"] else {}
        out["output_json"] = canonical((known if isinstance(known, dict) else {"value": known}) | {"source_projections": odd})
    out["at_ms"] = max((r["at_ms"] for r in rows if r["at_ms"] is not None), default=None)
    return [out]


#: Characters that JSON escapes by number: such texts take the way of calls with several records.
_NUMBERED = r"[\x00-\x07\x0b\x0e-\x1f]"
#: Keys of calls with several records that are broadcast.
BROADCAST_KEYS = 1 << 17


def reconcile(results: DataFrame) -> DataFrame:
    """call_key, returned_at_ms, is_error, output_text, output_json, result_sha256, result_key after merging each call's records.

    A call with one record, as nearly all are, is that record; only calls with several, which are counted first, are folded in Python.
    """
    schema = "call_key string, returned_at_ms long, is_error boolean, output_text string, output_json string, result_sha256 string, result_key string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        out = []
        for r in merge_outputs(rows):
            digest = sha256(canonical({"is_error": r["is_error"], "json": r["output_json"], "text": r["output_text"]}))
            out.append((r["call_key"], r["at_ms"], r["is_error"], r["output_text"], r["output_json"], digest, key("result", r["call_key"], bytes.fromhex(digest))))
        return pd.DataFrame(out, columns=names)

    cols = ("call_key", "role", "native_kind", "at_ms", "line_no", "item", "is_error", "output_text", "output_json")
    own = results.where("call_key is not null").select(*cols)
    odd = F.coalesce(F.col("output_text").rlike(_NUMBERED), F.lit(False)) | F.coalesce(F.col("output_json").rlike(_NUMBERED), F.lit(False))
    more = own.select("call_key", odd.alias("odd")).groupBy("call_key").agg((F.count("*") + F.count_if("odd")).alias("n")).where("n > 1").select("call_key")
    if more.count() <= BROADCAST_KEYS:  # then no text moves
        more = F.broadcast(more)
    one = own.join(more, "call_key", "left_anti").select("call_key", F.col("at_ms").alias("returned_at_ms"), "is_error", "output_text", "output_json")
    text = F.to_json(F.struct(F.col("is_error"), F.col("output_json").alias("json"), F.col("output_text").alias("text")), {"ignoreNullFields": "false"})
    one = one.withColumn("result_sha256", F.sha2(text, 256))
    sized = lambda c: F.concat(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0"), F.hex(F.encode(c, "UTF-8")))
    one = one.withColumn("result_key", F.sha2(F.unhex(F.concat(sized(F.lit("result")), sized(F.col("call_key")), F.lit("0" * 14 + "20"), "result_sha256")), 256))
    several = own.join(more, "call_key", "left_semi").groupBy("call_key").applyInPandas(run, schema)
    return one.select(*names).unionByName(several)


def _fields(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Length-delimited protobuf fields of a message; others are passed over."""
    i = 0

    def varint(i):
        n = shift = 0
        while True:
            b = raw[i]
            n, shift, i = n | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                return n, i

    while i < len(raw):
        tag, i = varint(i)
        if tag & 7 == 0:
            _, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            yield tag >> 3, raw[i : i + n]
            i += n
        else:
            i += {1: 8, 5: 4}.get(tag & 7, len(raw))


def _cursor_events_of(path: str, n: int, session: str, message) -> list[dict]:
    """Events of one message of a conversation store."""
    rows, content = [], message.get("content") if isinstance(message, dict) else None
    for i, b in enumerate(x for x in (content if isinstance(content, list) else []) if isinstance(x, dict)):
        base = {"path": path, "line_no": n, "session_id": session}
        if b.get("type") == "tool-call":
            form, text = _input(b.get("args"))
            rows.append(base | _event("call", "tool-call", i, native_call_id=b.get("toolCallId"), tool_name=b.get("toolName"), input_format=form, input_text=text))
        elif b.get("type") == "tool-result":
            out = b.get("result")
            rows.append(base | _event("result", "tool-result", i, native_call_id=b.get("toolCallId"), output_text=out if isinstance(out, str) else None, output_json=None if isinstance(out, str) or out is None else canonical(out)))
    return rows


def _cursor_message(path: str, n: int, session: str, raw: bytes) -> list[dict]:
    try:
        return _cursor_events_of(path, n, session, json.loads(raw))
    except ValueError:
        return []


def cursor_store(path: str, raw: bytes) -> list[dict]:
    """Events of one SQLite conversation store, in the order of its root record."""
    db = sqlite3.connect(":memory:")
    db.deserialize(raw)
    blobs = {k: bytes(v) for k, v in db.execute("select id, data from blobs")}
    meta = db.execute("select value from meta where key = '0'").fetchone()
    head = json.loads(bytes.fromhex(meta[0])) if meta else {}
    order = [v.hex() for f, v in _fields(blobs.get(head.get("latestRootBlobId"), b"")) if f == 1 and len(v) == 32]
    rows = []
    for n, blob in enumerate(dict.fromkeys([*order, *sorted(set(blobs) - set(order))]), 1):
        try:
            message = json.loads(blobs.get(blob, b""))
        except ValueError:
            continue
        rows += _cursor_events_of(path, n, head.get("agentId") or path, message)
    return rows


def cursor_events(content: DataFrame) -> DataFrame:
    """Events of store files (path, content), opened in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in b[["path", "content"]].itertuples(index=False):
                yield pd.DataFrame(cursor_store(path, bytes(raw)), columns=_NAMES).astype(object).where(lambda x: x.notna(), None)

    return content.select("path", "content").mapInPandas(run, EVENTS)


def _table(spark: SparkSession, root: str, table: str, columns: str, glob: str) -> DataFrame:
    from tallyloom.sources.sqlite_rows import FORMAT, SqliteRows

    spark.dataSource.register(SqliteRows)
    return spark.read.format(FORMAT).schema(f"path string, row long, {columns}").option("table", table).option("glob", glob).load(root)


def cursor_stores(spark: SparkSession, root: str) -> DataFrame:
    """``cursor_events`` of all stores below a folder, a blob at a time: a store's root record gives the order of its blobs, in a join; no task holds a store."""
    blobs = _table(spark, root, "blobs", "id string, data binary", "store.db")
    meta = _table(spark, root, "meta", "key string, value string", "store.db").where("key = '0'")
    head = F.unhex("value").cast("string")
    heads = meta.select("path", F.get_json_object(head, "$.latestRootBlobId").alias("root"), F.coalesce(F.get_json_object(head, "$.agentId"), F.col("path")).alias("session"))

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, v.hex(), k) for path, raw in b[["path", "data"]].itertuples(index=False) for k, v in enumerate(dict.fromkeys(v for f, v in _fields(bytes(raw)) if f == 1 and len(v) == 32))]
            yield pd.DataFrame(rows, columns=["path", "id", "place"])

    own = heads.select("path", F.col("root").alias("id"))
    places = blobs.join(own, ["path", "id"]).select("path", "data").mapInPandas(ordered, "path string, id string, place long")
    there = places.join(blobs.select("path", "id"), ["path", "id"], "full").withColumn("rest", F.col("place").isNull())
    numbered = there.withColumn("line_no", F.expr("row_number() over (partition by path order by rest, place, id)").cast("long")).select("path", "id", "line_no")
    rows = blobs.join(numbered, ["path", "id"]).join(heads.select("path", "session"), "path", "left").select("path", "line_no", F.coalesce("session", "path").alias("session"), "data")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [e for path, n, session, raw in b[["path", "line_no", "session", "data"]].itertuples(index=False) for e in _cursor_message(path, n, session, bytes(raw or b""))]
            yield pd.DataFrame(out, columns=_NAMES).astype(object).where(lambda x: x.notna(), None)

    return rows.mapInPandas(read, EVENTS)


def threads(spark: SparkSession, root: str, glob: str = "state*.sqlite") -> DataFrame:
    """session_id, started_at_ms, working_directory, provider, model of the host's table of threads, which fills what rollouts leave out."""
    found = _table(spark, root, "threads", "id string, created_at_ms long, created_at long, cwd string, model_provider string, model string", glob)
    return found.select(F.col("id").alias("session_id"), F.coalesce("created_at_ms", F.col("created_at") * 1000).alias("started_at_ms"), F.col("cwd").alias("working_directory"), F.col("model_provider").alias("provider"), "model")


def codex_sessions(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """session_id, started_at_ms, working_directory, provider, model of rollouts (lines with their number and record); known: ``threads``, for what a header lacks."""
    at = lambda p: F.get_json_object("record", f"$.payload.{p}")
    heads = lines.where("line_no = 1 and valid").where(F.get_json_object("record", "$.type") == "session_meta")
    own = heads.select(at("id").alias("session_id"), at("timestamp").alias("t"), at("cwd").alias("working_directory"), at("model_provider").alias("provider"), at("model").alias("model")).where("session_id is not null")
    own = own.groupBy("session_id").agg(*[F.min(c).alias(c) for c in ("t", "working_directory", "provider", "model")])
    own = own.withColumn("started_at_ms", F.expr("try_cast(t as timestamp)").cast("double") * 1000).withColumn("started_at_ms", F.round("started_at_ms").cast("long"))
    names = ("started_at_ms", "working_directory", "provider", "model")
    if known is None:
        return own.select("session_id", *names)
    k = known.select("session_id", *[F.col(c).alias(f"{c}_") for c in names])
    return own.join(k, "session_id", "left").select("session_id", *[F.coalesce(c, f"{c}_").alias(c) for c in names])


SAVED = "Full output saved to: "


def referenced(results: DataFrame, root: str) -> DataFrame:
    """Results (with output_text) whose text names a file of saved output below ``root``, in a folder ``tool-results``: the file's text in its place.

    Links are followed before a path is judged. A path outside, a file that isn't there and one that is no text leave the result as it is, with
    reference_issue saying so. Only files that a result names are opened, by the task that has the result.
    """
    path = F.trim(F.regexp_extract("output_text", SAVED + r"([^\r\n]*)", 1))
    named = results.withColumn("_path", F.when(F.col("output_text").contains(SAVED) & (path != ""), path))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in results.schema)}, reference_issue string"
    base = root.removeprefix("file://").removeprefix("file:")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside = os.path.realpath(base)
        for b in batches:
            texts, issues = [], []
            for text, name in b[["output_text", "_path"]].itertuples(index=False):
                real, issue = os.path.realpath(name), None
                if not real.startswith(inside + os.sep) or "tool-results" not in real.split(os.sep):
                    issue = "outside"
                else:
                    try:
                        with open(real, encoding="utf-8", newline="") as f:
                            text = f.read()
                    except UnicodeDecodeError:
                        issue = "not text"
                    except OSError:
                        issue = "missing"
                texts.append(text)
                issues.append(issue)
            yield b.drop(columns="_path").assign(output_text=texts, reference_issue=issues)

    plain = named.where("_path is null").drop("_path").withColumn("reference_issue", F.lit(None).cast("string"))
    return plain.unionByName(named.where("_path is not null").mapInPandas(read, schema))
