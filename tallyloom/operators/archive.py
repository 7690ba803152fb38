"""The archive of payloads and snapshots: content-addressed, verified, searched by line, pruned.

Tables: payloads (sha256, compression, bytes, body) and snapshots (call_key, subject, stage, sha256,
completeness). Payload bodies move only in the operators that must read them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.batches import each
from tallyloom.operators.reduce import strip_escapes

# Fixed values.
LEVEL, KEEP_AT_MOST = 3, 95
SUBJECTS = ("input", "result", "result_text", "source_output", "stdout", "stderr")
STAGES = ("before", "after")
PRIORITY = (("stdout", "stderr"), ("result_text",), ("source_output",))
LINE_BYTES, SOURCE_BYTES, MATCHES, RENDERED = 4096, 7168, 20, 32
_PAYLOADS = pa.schema([("sha256", pa.string()), ("compression", pa.string()), ("bytes", pa.int64()), ("body", pa.binary())])
_BODIES = pa.schema([("sha256", pa.string()), ("body", pa.binary()), ("fault", pa.string())])
_FOUND = pa.schema([("call_key", pa.string()), ("subject", pa.string()), ("matches", pa.int64()), ("rendering", pa.string())])


def store(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, snapshots) of rows (call_key, subject, stage, completeness, body): each body once, compressed where that saves a twentieth."""
    named = snapshots.withColumn("sha256", F.sha2("body", 256))
    once = named.groupBy("sha256").agg(F.first("body").alias("body"))

    def pack(digest: str, raw: bytes) -> list[tuple]:
        small = zstandard.ZstdCompressor(LEVEL).compress(raw)
        return [(digest, "zstd", len(raw), small) if 100 * len(small) <= KEEP_AT_MOST * len(raw) else (digest, "none", len(raw), raw)]

    payloads = each(once, pack, _PAYLOADS)
    return payloads, named.select("call_key", "subject", "stage", "completeness", "sha256").distinct()


def restore(payloads: DataFrame) -> DataFrame:
    """sha256, body, fault of payloads: bodies unpacked, and what is wrong with them."""

    def unpack(digest: str, compression: str, size: int, raw: bytes) -> list[tuple]:
        try:
            body = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size) if compression == "zstd" else raw
            fault = "length" if len(body) != size else "digest" if hashlib.sha256(body).hexdigest() != digest else None
        except zstandard.ZstdError:
            body, fault = None, "compression"
        return [(digest, body, fault)]

    return each(payloads.select("sha256", "compression", "bytes", "body"), unpack, _BODIES)


def verify(payloads: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(problem, n) of every check that fails."""
    s, p = snapshots, payloads.select("sha256")
    checks = [
        ("subject", s.where(~F.col("subject").isin(*SUBJECTS))),
        ("stage", s.where(~F.col("stage").isin(*STAGES))),
        ("completeness", s.where("(completeness is not null) <> (subject = 'result_text' and stage = 'before') or completeness not in ('complete', 'incomplete', 'unknown')")),
        ("conflict", s.groupBy("call_key", "subject", "stage").agg(F.countDistinct("sha256").alias("n")).where("n > 1")),
        ("missing payload", s.join(p, "sha256", "left_anti")),
        ("unused payload", p.join(s, "sha256", "left_anti")),
        ("damaged payload", restore(payloads).where("fault is not null")),
    ]
    found = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, df in checks]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.where("n > 0")


def prune(payloads: DataFrame, snapshots: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the calls of ``gone`` and the payloads that none needs any more."""
    kept = snapshots.join(gone.select("call_key").distinct(), "call_key", "left_anti")
    return payloads.join(kept.select("sha256").distinct(), "sha256", "left_semi"), kept


@dataclass(frozen=True)
class Search:
    """A search: up to eight patterns, as regular expressions or fixed, in context."""

    patterns: tuple[str, ...]
    fixed: bool = False
    fold: bool = False
    word: bool = False
    invert: bool = False
    before: int = 2
    after: int = 2
    limit: int = MATCHES

    def __post_init__(self):
        if not 1 <= len(self.patterns) <= 8 or any(not 1 <= len(p.encode()) <= 1024 for p in self.patterns):
            raise ValueError("one to eight patterns of 1 to 1024 bytes")
        if not self.fixed and any(re.search(r"\\[1-9]|\(\?[=!<]", p) for p in self.patterns):
            raise ValueError("no backreferences or lookaround")
        if not 1 <= self.limit <= 100:
            raise ValueError("1 to 100 results")

    def compiled(self) -> re.Pattern:
        body = "|".join(re.escape(p) if self.fixed else f"(?:{p})" for p in self.patterns)
        body = rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])" if self.word else body
        return re.compile(body.encode(), re.I if self.fold else 0)


def shown(line: bytes) -> str:
    """A line as it is printed: no escapes, control characters spelled out, at most 4 KiB."""
    text = strip_escapes(line).decode()
    text = "".join(c if c == "\t" or c.isprintable() or ord(c) > 159 else f"\\x{ord(c):02x}" if ord(c) < 128 else f"\\u{{{ord(c):x}}}" for c in text)
    raw = text.encode()
    return text if len(raw) <= LINE_BYTES else raw[:LINE_BYTES].decode(errors="ignore")


def search_text(raw: bytes, s: Search) -> tuple[int, str]:
    """(matches, rendering) of one source: matches with ``:``, context with ``-``, ``--`` between groups, in bounded size."""
    lines = [x.removesuffix(b"\r") for x in (raw[:-1] if raw.endswith(b"\n") else raw).split(b"\n")] if raw else []
    p = s.compiled()
    hits = [i for i, x in enumerate(lines) if bool(p.search(strip_escapes(x))) != s.invert]
    first, before, after = hits[: min(s.limit, RENDERED)], s.before, s.after
    while True:
        groups: list[list[int]] = []
        for h in first:
            a, b = max(0, h - before), min(len(lines) - 1, h + after)
            if groups and a <= groups[-1][1] + 1:
                groups[-1][1] = max(groups[-1][1], b)
            else:
                groups.append([a, b])
        chosen = set(first)
        parts = ["\n".join(f"{i + 1}{':' if i in chosen else '-'}{shown(lines[i])}" for i in range(a, b + 1)) for a, b in groups]
        text = "\n--\n".join(parts)
        if len(text.encode()) <= SOURCE_BYTES or not first:
            return len(hits), text
        if before or after:
            before, after = max(0, before - 1), max(0, after - 1)
        else:
            first = first[:-1]


def read_lines(raw: bytes, start: int, end: int) -> bytes:
    """Lines start to end, 1-based and inclusive, with their endings."""
    lines = raw.split(b"\n")
    lines = lines[:-1] if lines[-1] == b"" else lines
    if not 1 <= start <= end <= len(lines):
        raise ValueError("range beyond the source")
    tail = b"\n" if end < len(lines) or raw.endswith(b"\n") else b""
    return b"\n".join(lines[start - 1 : end]) + tail


def read_bytes(raw: bytes, start: int, end: int) -> bytes:
    """Bytes start to end, 0-based and half open."""
    if not 0 <= start <= end <= len(raw):
        raise ValueError("range beyond the source")
    return raw[start:end]


def sources(payloads: DataFrame, snapshots: DataFrame) -> DataFrame:
    """call_key, subject, completeness, body of each call's best source: its streams, else its result's text, else the host's output."""
    rank = F.expr("case when subject in ('stdout', 'stderr') then 1 when subject = 'result_text' then 2 when subject = 'source_output' then 3 end")
    own = snapshots.where("stage = 'before'").withColumn("_rank", rank).where("_rank is not null")
    best = own.groupBy("call_key").agg(F.min("_rank").alias("_rank"))
    return own.join(best, ["call_key", "_rank"]).join(restore(payloads).where("fault is null"), "sha256").select("call_key", "subject", F.coalesce("completeness", F.lit("complete")).alias("completeness"), "body")


def search(found: DataFrame, s: Search) -> DataFrame:
    """call_key, subject, matches, rendering of sources that hold a match."""

    def run(key: str, subject: str, raw: bytes) -> list[tuple]:
        try:
            n, text = search_text(raw, s)
        except UnicodeDecodeError:
            return []
        return [(key, subject, n, text)] if n else []

    return each(found.select("call_key", "subject", "body"), run, _FOUND)


def lifecycle(operations: DataFrame) -> DataFrame:
    """call_key, status, executed, is_error, subjects, conflicts, misplaced of ordered operations (call_key, seq, operation, subject, sha256, is_error).

    Repeats of an identical operation change nothing; a second content for the same place is a conflict. Misplaced are
    operations before their call began (or without it), and results of a finished call that are no final update.
    """
    o = operations
    at = lambda op: F.min(F.when(F.col("operation") == op, F.col("seq")))
    ends = o.groupBy("call_key").agg(at("begin_call").alias("begun"), at("finish_call").alias("ended"))
    early = F.col("begun").isNull() | (F.col("seq") < F.col("begun"))
    late = (F.col("seq") > F.col("ended")) & ~F.col("operation").isin("finish_call", "update_final_result", "begin_call")
    odd = o.join(ends, "call_key").where(early | F.coalesce(late, F.lit(False))).groupBy("call_key").agg(F.count("*").alias("misplaced"))
    last = F.max_by("is_error", F.struct("seq")).alias("is_error")
    state = o.groupBy("call_key").agg(
        F.max(F.col("operation") == "finish_call").alias("finished"),
        F.max(F.col("operation").isin("result_before", "result_text", "finish_call")).alias("executed"),
        F.sort_array(F.collect_set("subject")).alias("subjects"),
    )
    flag = o.where("operation in ('finish_call', 'update_final_result')").groupBy("call_key").agg(last)
    clash = o.where("subject is not null and operation <> 'update_final_result'").groupBy("call_key", "subject", "operation").agg(F.countDistinct("sha256").alias("n")).where("n > 1")
    clash = clash.groupBy("call_key").agg(F.count("*").alias("conflicts"))
    out = state.join(flag, "call_key", "left").join(clash, "call_key", "left").join(odd, "call_key", "left")
    return out.select("call_key", F.when(F.col("finished"), "finished").otherwise("open").alias("status"), "executed", "is_error", "subjects", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("misplaced", F.lit(0)).alias("misplaced"))


def media_type(body: str) -> str:
    """SQL: the type that a stored stream is given: text where its bytes are UTF-8."""
    return f"case when is_valid_utf8(cast({body} as string)) then 'text/plain; charset=utf-8' else 'application/octet-stream' end"
