"""Framed record streams and event streams.

A framed stream is JSON lines {record, value}. Sources arrive between source_start and source_commit (or
rollback); only committed sources count, whole streams that break the frame are refused. Each micro-batch
merges what it commits into a table of files by run, so a batch that runs twice leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
RECORDS = (
    "stream_start", "stream_end", "source_start", "source_commit", "source_rollback", "source_root", "source_item", "reset_source",
    "session", "tool_call", "tool_result", "observation", "issue",
)
FRAME = "stream string, seq long, record string, value string"


def parse(lines: DataFrame) -> DataFrame:
    """Frames of rows (stream, seq, value)."""
    return lines.select("stream", "seq", F.get_json_object("value", "$.record").alias("record"), F.get_json_object("value", "$.value").alias("value"))


def committed(frames: DataFrame) -> DataFrame:
    """Frames (stream, seq, record, value) inside sources that were committed, with their source's number.

    A source ends at the next commit, rollback or start; without a commit nothing of it counts.
    """
    w = Window.partitionBy("stream").orderBy("seq")
    starts = frames.withColumn("source", F.sum(F.when(F.col("record") == "source_start", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = starts.groupBy("stream", "source").agg(
        F.min(F.when(F.col("record").isin("source_commit", "source_rollback"), F.struct("seq", "record"))).alias("end")
    )
    inside = starts.join(ends, ["stream", "source"]).where("source > 0 and end.record = 'source_commit' and seq < end.seq and record <> 'source_start'")
    return inside.select("stream", "source", "seq", "record", "value")


def faults(frames: DataFrame) -> DataFrame:
    """Streams that break the frame: (stream, fault)."""
    w = Window.partitionBy("stream").orderBy("seq")
    f = frames.withColumn("before", F.lag("record").over(w)).withColumn("after", F.lead("record").over(w))
    bad = F.expr(f"""case when record is null or record not in {RECORDS} then 'unknown record' when before is null and record <> 'stream_start' then 'no start'
      when after is null and record <> 'stream_end' then 'no end' when record = 'stream_start' and before is not null then 'second start' end""")
    return f.withColumn("fault", bad).where("fault is not null").groupBy("stream").agg(F.min("fault").alias("fault"))


def merge(rows: DataFrame) -> DataFrame:
    """record, key, value: the first of each key in the streams' order."""
    keyed = rows.where("record in ('session', 'tool_call', 'tool_result', 'observation', 'issue')").withColumn("key", F.get_json_object("value", "$.key"))
    return keyed.groupBy("record", "key").agg(F.min_by("value", F.struct("stream", "seq")).alias("value"))


def stream_to_table(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """A query that follows a folder of framed files (a file is a stream) and keeps ``table`` (parquet by batch); run with available-now."""
    lines = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.jsonl").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    cut = lines.select(F.col("path").alias("stream"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("seq", "value")).where("value <> ''")

    def each(batch: DataFrame, number: int) -> None:
        frames = parse(batch)
        good = frames.join(faults(frames), "stream", "left_anti")
        merge(committed(good)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return cut.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    """record, key, value over all batches: the earliest batch wins."""
    rows = spark.read.parquet(path)
    return rows.groupBy("record", "key").agg(F.min_by("value", "batch").alias("value"))


def windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by day and type, for batch tables and, with late data up to the watermark, for streams."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "cents")
