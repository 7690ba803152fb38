"""Line-delimited logs with line numbers, byte offsets, digests and checkpoints, read in Spark's own splits.

A file of any size is as many tasks as it has splits. Each task counts the lines and bytes of its splits;
sums over a file's earlier splits, a row for each, turn them into places in the file. A last line
without its line feed is not yet a record.

A checkpoint says how far a file was read and what stood there: the sum over its lines of a hash of place
and digest, which needs no order. Files of the same size and time as their checkpoint are not read;
of the others, those with an unchanged beginning go on after it, and those without start again (a reset).
A file that shrinks, goes or changes while it is read is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "path string, line_no long, byte_offset long, record string, record_sha256 string, valid boolean, reset boolean"
CHECKPOINT = "path string, size long, modified timestamp, offset long, lines long, digest decimal(38,0)"
#: Splits, a short row each, that are broadcast.
BROADCAST_ROWS = 1 << 20


def files(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """path, size, modified of the files below root; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def discover(spark: SparkSession, root: str, agent: str) -> DataFrame:
    """The files of an agent below root: its logs, for one that keeps stores these and their transcripts."""
    if agent != "cursor":
        return files(spark, root)
    return files(spark, root, "{store.db,*.jsonl}").where("path like '%/store.db' or path rlike '/agent-transcripts/[^/]+[.]jsonl$'")


def fresh(listing: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The files that differ from their checkpoint in size or time, or have none."""
    return listing.join(checkpoints.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def rejected(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, code of the files that went, shrank, or changed at the same size between two listings: what was read of them doesn't count. Growth is no change of what stood there."""
    now = after.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"))
    gone = before.join(now, "path", "left").where("_s is null or _s < size or (_s = size and _m <> modified)")
    return gone.select("path", F.lit("source_changed_during_read").alias("code"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number and offset within their split; a split's lines come in order."""
    last, line, offset = None, 0, 0
    for b in batches:
        size = np.asarray(b.column("bytes")) + 1
        split = list(zip(b.column("path").to_pylist(), b.column("block").to_pylist(), strict=True))
        numbers, offsets = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        begin = 0
        while begin < len(split):
            end = begin + 1
            while end < len(split) and split[end] == split[begin]:
                end += 1
            if split[begin] != last:
                last, line, offset = split[begin], 0, 0
            numbers[begin:end] = line + 1 + np.arange(end - begin)
            sums = offset + np.cumsum(size[begin:end])
            offsets[begin:end] = sums - size[begin:end]
            line, offset, begin = line + end - begin, int(sums[-1]), end
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers), pa.array(offsets)], names=[*b.schema.names, "line_no", "byte_offset"])


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line_no (from 1), byte_offset, end, bytes, record, size, modified of every terminated line of these files."""
    text = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"), F.col("value").cast("binary").alias("raw"), F.octet_length("value").alias("bytes"),
    )
    shape = "path string, block long, size long, modified timestamp, raw binary, bytes int, line_no long, byte_offset long"
    own = text.mapInArrow(_counted, shape)
    splits = text.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum(F.col("bytes").cast("long") + 1).alias("b"))
    before = lambda c: F.expr(f"coalesce(sum({c}) over (partition by path order by block rows between unbounded preceding and 1 preceding), 0)")
    bases = splits.select("path", "block", before("n").alias("lines_before"), before("b").alias("bytes_before"))
    if splits.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    out = own.join(bases, ["path", "block"]).withColumns({"line_no": F.col("line_no") + F.col("lines_before"), "byte_offset": F.col("byte_offset") + F.col("bytes_before")})
    out = out.withColumn("end", F.col("byte_offset") + F.col("bytes") + 1).where("end <= size")
    return out.select("path", "line_no", "byte_offset", "end", "bytes", "raw", "size", "modified")


def _digest() -> Column:
    return F.xxhash64("byte_offset", "raw").cast("decimal(20,0)")


def checkpoints(scanned: DataFrame) -> DataFrame:
    """``CHECKPOINT`` rows of scanned files: how far the terminated lines go."""
    return scanned.groupBy("path", "size", "modified").agg(F.max("end").alias("offset"), F.max("line_no").alias("lines"), F.sum(_digest()).cast("decimal(38,0)").alias("digest"))


def lines(scanned: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """``LINES`` of scanned files: those past their checkpoint, or all of a file that was reset. Blank lines are no records."""
    rows = scanned.withColumn("reset", F.lit(False))
    if checkpoints is not None:
        known = checkpoints.select("path", F.col("offset").alias("_o"), F.col("digest").alias("_d"))
        old = scanned.join(known, "path").groupBy("path", "_o", "_d").agg(F.sum(F.when(F.col("end") <= F.col("_o"), _digest())).alias("_now"), F.max("end").alias("_end"))
        state = old.select("path", F.col("_o"), (~(F.col("_now").eqNullSafe(F.col("_d")) & (F.col("_end") >= F.col("_o")))).alias("_reset"))
        rows = scanned.join(state, "path", "left").withColumn("reset", F.coalesce("_reset", F.lit(False))).where("reset or _o is null or byte_offset >= _o")
    valid = F.expr("is_valid_utf8(cast(raw as string)) and try_parse_json(cast(raw as string)) is not null")
    blank = F.trim(F.regexp_replace(F.col("raw").cast("string"), r"[\t\r\x0b\x0c]", " ")) == ""
    return rows.where(~blank).select("path", "line_no", "byte_offset", F.expr("make_valid_utf8(cast(raw as string))").alias("record"), F.sha2("raw", 256).alias("record_sha256"), F.coalesce(valid, F.lit(False)).alias("valid"), "reset")


def decisions(scanned: DataFrame, checkpoints: DataFrame, version: int = 1) -> DataFrame:
    """path, decision (new, resume or reset), start, message of scanned files against their checkpoints (with a version, or of this one).

    A reset starts at 0 and says why: another version of the reader or a file shorter than what was read of it, no digest, lines that end
    before the checkpoint does, or other bytes before it.
    """
    known = checkpoints.select("path", F.col("offset").alias("_o"), F.col("digest").alias("_d"), (F.col("version") if "version" in checkpoints.columns else F.lit(version)).alias("_v"))
    now = scanned.join(known, "path", "left").groupBy("path", "_o", "_d", "_v").agg(F.max("size").alias("size"), F.max("end").alias("end"), F.sum(F.when(F.col("end") <= F.col("_o"), _digest())).cast("decimal(38,0)").alias("now"))
    message = F.when((F.col("_v") != version) | (F.col("_o") > F.col("size")), "source identity changed").when(F.col("_d").isNull(), "no digest of the checkpoint").when(F.col("end") < F.col("_o"), "lines end before the checkpoint").when(~F.col("now").eqNullSafe(F.col("_d")), "bytes before the checkpoint changed")
    message = F.when(F.col("_o").isNotNull(), message)
    decision = F.when(F.col("_o").isNull(), "new").when(F.col("message").isNotNull(), "reset").otherwise("resume")
    return now.withColumn("message", message).select("path", decision.alias("decision"), F.when(decision == "resume", F.col("_o")).otherwise(F.lit(0)).alias("start"), "message")


def issues(decided: DataFrame, read: DataFrame) -> DataFrame:
    """path, code, line_no, byte_offset, record_sha256, message of an import: resets, and lines (``lines``) that are no JSON."""
    none = lambda kind: F.lit(None).cast(kind)
    resets = decided.where("decision = 'reset'").select("path", F.lit("checkpoint_reset").alias("code"), none("long").alias("line_no"), none("long").alias("byte_offset"), none("string").alias("record_sha256"), "message")
    bad = read.where("not valid").select("path", F.lit("malformed_jsonl").alias("code"), "line_no", "byte_offset", "record_sha256", F.lit("no JSON").alias("message"))
    return resets.unionByName(bad)
