"""The imported tables as a set of Parquet folders that change by whole versions.

A run writes its new tables beside the old ones, in folders of its own, and then puts the next number into the log: a
file that names the folder of every table, written aside and renamed into place, which only one run can do. Readers take the
log's last entry only. So a run that dies leaves folders that nobody reads and blocks no one; of two runs that began at one entry
the second loses the rename, and ``commit`` works its change out again over what the first left. Merges are first-wins: a stored key stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"sessions": "session_key", "tool_calls": "call_key", "tool_results": "result_key", "observations": "observation_key", "import_issues": "issue_key"}


def merged(stored: DataFrame | None, staged: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Stored rows, and of each new key the first staged row by ``order``."""
    cols = staged.columns
    first = staged.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")
    if stored is None:
        return first
    return stored.unionByName(first.join(stored.select(key), key, "left_anti").select(*cols))


def upserted(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows in place of the stored ones of their key."""
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def without_source(observations: DataFrame, results: DataFrame, calls: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a source: results and calls that only it observed go (calls with a result left stay)."""
    mine, others = observations.where(F.col("source_item_key") == source), observations.where(F.col("source_item_key") != source)
    dead = mine.select("result_key").where("result_key is not null").distinct().join(others.select("result_key"), "result_key", "left_anti")
    left = results.join(dead, "result_key", "left_anti")
    touched = mine.select("call_key").unionByName(results.join(mine.select("result_key"), "result_key", "left_semi").select("call_key")).where("call_key is not null").distinct()
    gone = touched.join(others.select("call_key"), "call_key", "left_anti").join(left.select("call_key"), "call_key", "left_anti")
    return others, left, calls.join(gone, "call_key", "left_anti")


class Conflict(ValueError):
    """Another run has this version."""


def _path(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, base: str) -> tuple[int, dict[str, str]]:
    """(version, folder of each table) of the log's last entry; version 0 without any."""
    fs, log = _path(spark, f"{base}/log")
    if not fs.exists(log):
        return 0, {}
    versions = [int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(log) if f.getPath().getName().endswith(".json")]
    if not versions:
        return 0, {}
    last = max(versions)
    text = "".join(r["value"] for r in spark.read.text(f"{base}/log/{last:020d}.json").collect())  # one line
    return last, json.loads(text)


def _enter(spark: SparkSession, base: str, version: int, tables: dict[str, str]) -> None:
    """Put an entry into the log, if no other run has."""
    fs, aside = _path(spark, f"{base}/log/{uuid.uuid4().hex}.tmp")
    out = fs.create(aside)
    out.write((json.dumps(tables) + "\n").encode())
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = next(x for x in kind.getEnumConstants() if x.toString() == "NONE")
    entry = jvm.org.apache.hadoop.fs.Path(f"{base}/log/{version:020d}.json")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(entry), none)
    except Exception as e:
        if fs.exists(entry):
            fs.delete(aside, False)
            raise Conflict(f"version {version} is another run's") from e
        raise


def read(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    found = current(spark, base)[1].get(table)
    return spark.read.parquet(found) if found else None


def publish(spark: SparkSession, base: str, version: int, tables: dict[str, DataFrame]) -> None:
    """Write tables and make them the given version, the next one after what they were worked out from. Tables that aren't given stay."""
    before, known = current(spark, base)
    if version <= before:
        raise Conflict(f"version {version} is another run's")
    run, found = uuid.uuid4().hex, dict(known)
    for name, df in tables.items():
        found[name] = f"{base}/{name}/version={version}-{run}"
        df.write.parquet(found[name])
    _enter(spark, base, version, found)


def commit(spark: SparkSession, base: str, change: Callable[[Callable[[str], DataFrame | None]], dict[str, DataFrame]], tries: int = 8) -> int:
    """Apply a change to the tables and give the version that it made. change: from a reader of tables to the tables that change; it runs again when another run was first."""
    for left in reversed(range(tries)):
        version, known = current(spark, base)
        reader = lambda name: spark.read.parquet(known[name]) if name in known else None  # noqa: E731, B023
        try:
            publish(spark, base, version + 1, change(reader))
            return version + 1
        except Conflict:
            if not left:
                raise
    raise AssertionError


def swept(spark: SparkSession, base: str, keep: int = 1) -> int:
    """Delete the folders that none of the last ``keep`` entries names, left by runs that died or were followed by others; how many. Only while no run writes."""
    version, _ = current(spark, base)
    fs, root = _path(spark, base)
    named = set()
    for v in range(max(1, version - keep + 1), version + 1):
        named |= set(json.loads("".join(r["value"] for r in spark.read.text(f"{base}/log/{v:020d}.json").collect())).values())
    gone = 0
    for table in fs.listStatus(root) if fs.exists(root) else []:
        if table.getPath().getName() != "log":
            for folder in fs.listStatus(table.getPath()):
                if f"{base}/{table.getPath().getName()}/{folder.getPath().getName()}" not in named:
                    fs.delete(folder.getPath(), True)
                    gone += 1
    return gone


def growth(results: DataFrame) -> DataFrame:
    """The bytes that an import may add: twice the payload and a kilobyte a row."""
    payload = F.sum(F.coalesce(F.octet_length("output_text"), F.lit(0)) + F.coalesce(F.octet_length("output_json"), F.lit(0)))
    return results.agg((F.coalesce(payload, F.lit(0)) * 2 + F.count("*") * 1024).alias("bytes"))


def transcript_check(calls: DataFrame, transcript: DataFrame) -> DataFrame:
    """session_id, place, verdict: a transcript's tool uses against stored calls, by position.

    calls and transcript: (session_id, line_no, item, tool_name, input_text).
    """
    place = F.expr("row_number() over (partition by session_id order by line_no, item)")
    a = calls.select("session_id", place.alias("place"), F.struct("tool_name", "input_text").alias("a"))
    b = transcript.select("session_id", place.alias("place"), F.struct("tool_name", "input_text").alias("b"))
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), "count").when(F.col("a") == F.col("b"), "validated").otherwise("mismatch")
    return a.join(b, ["session_id", "place"], "full").select("session_id", "place", verdict.alias("verdict"))


def transcript_records(calls: DataFrame, transcript: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, issues) of transcripts' tool uses against stored calls, by position.

    calls: (session_id, line_no, item, call_key, tool_name, input_text); transcript: without call_key. A use that is its place's call
    observes that call. A line with a use that isn't, or that has no call left, is one issue (its first); a session whose transcript ends before
    its calls do is one more. Sessions without calls are no transcript's.
    """
    place = F.expr("row_number() over (partition by session_id order by line_no, item)")
    a = calls.select("session_id", place.alias("place"), "call_key", F.struct("tool_name", "input_text").alias("a"))
    known = calls.groupBy("session_id").agg(F.count("*").alias("calls"))
    b = transcript.select("session_id", place.alias("place"), "line_no", "item", F.struct(F.coalesce("tool_name", F.lit("")).alias("tool_name"), "input_text").alias("b"))
    met = b.join(known, "session_id").join(a, ["session_id", "place"], "left").withColumn("same", F.coalesce(F.col("a") == F.col("b"), F.lit(False)))
    observations = met.where("same").select("session_id", "call_key", (F.col("place") - 1).alias("sequence_number"), "line_no", F.col("item").alias("content_index"), F.lit("transcript.tool_use").alias("native_record_kind"))
    message = F.when(F.col("place") > F.col("calls"), "more calls than the store has").otherwise("a call that the store has otherwise")
    wrong = met.where("not same").groupBy("session_id", "line_no").agg(F.min_by(message, "item").alias("message"))
    short = b.groupBy("session_id").agg(F.count("*").alias("n")).join(known, "session_id").where("n < calls")
    issues = wrong.select("session_id", F.lit("cursor_transcript_mismatch").alias("code"), "line_no", "message")
    issues = issues.unionByName(short.select("session_id", F.lit("cursor_transcript_count_mismatch").alias("code"), F.lit(None).cast("long").alias("line_no"), F.lit("fewer calls than the store has").alias("message")))
    return observations, issues
