"""Results and calls paired in a stream, in whatever order they come.

A state for each session and native call id holds its calls and the results that were seen. A result gets a verdict when it comes
(its call, ``ambiguous_call_id`` or ``result_without_call``), and another one whenever later calls change it: so a result without a call is held,
and found its call when that is appended. Verdicts are appended with rising versions; ``settled`` takes the last of each result, which is
what ``agents.paired`` says of the same events in a batch. With ``hold_ms`` a result that still has no call after that time is let go of.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyloom.sources import agents
from tallyloom.streaming.apply import ROCKS, STORE

VERDICTS = "session_id string, native_call_id string, path string, line_no long, item long, call_key string, issue string, version long"
_NAMES = [c.split()[0] for c in VERDICTS.split(", ")]
_EVENT = ["path", "line_no", "item", "role", "call_key", "entry_id", "parent_id"]


def verdict(calls: dict[str, str | None], parent: str | None) -> tuple[str | None, str | None]:
    """(call, issue) of a result among the calls of its id: that whose entry is its parent, else the only one."""
    own = [k for k, entry in calls.items() if parent is not None and entry == parent]
    if own:
        return max(own), None
    if len(calls) == 1:
        return next(iter(calls)), None
    return None, "ambiguous_call_id" if calls else "result_without_call"


class Pairing(StatefulProcessor):
    """Calls and results of one session and native call id."""

    def __init__(self, hold_ms: int = 0):
        self.hold_ms = hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "call_key string", "entry_id string")
        self.results = handle.getMapState("results", "place string", "parent_id string, call_key string, issue string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls, out, new = {k[0]: v[0] for k, v in self.calls.iterator()}, [], {}
        for pdf in rows:
            for path, line, item, role, call, entry, parent in pdf[_EVENT].astype(object).where(pdf[_EVENT].notna(), None).itertuples(index=False):
                if role == "call":
                    if call not in calls:
                        calls[call] = entry
                        self.calls.updateValue((call,), (entry,))
                        new[call] = entry
                else:
                    place = json.dumps([path, int(line), int(item)])
                    if not self.results.containsKey((place,)):
                        self.results.updateValue((place,), (parent, None, None, 0))
        for (place,), (parent, call, issue, version) in list(self.results.iterator()):
            if version and not new:
                continue
            now = verdict(calls, parent)
            if not version or now != (call, issue):
                self.results.updateValue((place,), (parent, *now, version + 1))
                path, line, item = json.loads(place)
                out.append((*key, path, line, item, *now, version + 1))
        if self.hold_ms and not calls and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)
        yield pd.DataFrame(out, columns=_NAMES).astype(object).where(lambda x: x.notna(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not list(self.calls.keys()):
            self.results.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def verdicts(events: DataFrame, agent: str, user: str = "user", hold_ms: int = 0) -> DataFrame:
    """``VERDICTS`` of a stream of events."""
    own = F.when(F.col("role") == "call", agents.call_key(agent, user)).alias("call_key")
    rows = events.select("session_id", F.coalesce("native_call_id", F.lit("")).alias("native_call_id"), "path", "line_no", "item", "role", own, "entry_id", "parent_id")
    return rows.groupBy("session_id", "native_call_id").transformWithStateInPandas(statefulProcessor=Pairing(hold_ms), outputStructType=VERDICTS, outputMode="Append", timeMode="ProcessingTime" if hold_ms else "None")


def follow(spark: SparkSession, folder: str, agent: str, table: str, checkpoint: str, glob: str = "*.jsonl"):
    """A query that follows an agent's growing logs and appends the verdicts on their results to ``table``; it ends with what is there."""
    from tallyloom.sources.appended import FORMAT, AppendedLines

    spark.conf.set(STORE, ROCKS)
    spark.dataSource.register(AppendedLines)
    lines = spark.readStream.format(FORMAT).option("glob", glob).load(folder)
    rows = verdicts(agents.followed(lines, agent), agent)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return rows.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(verdicts: DataFrame) -> DataFrame:
    """The last verdict on each result."""
    last = F.max_by(F.struct("session_id", "native_call_id", "call_key", "issue"), "version").alias("v")
    return verdicts.groupBy("path", "line_no", "item").agg(last).select("path", "line_no", "item", "v.*")
