"""The archive's operations applied in a stream: one state a call, kept by Spark, and changes appended by micro-batch.

The state store holds each call's bounded state, its version, and operations that came before their call was begun: these wait for
it up to a time limit, are applied in order when it comes and refused when the time is over (a limit of none refuses them at once, as
a batch does). A stream that is restarted goes on with its states; a micro-batch that runs twice overwrites its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyloom.operators import lifecycle as lc
from tallyloom.streaming import frames

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["stream", "seq", "request_id", "message", "full_output"]


class Applier(StatefulProcessor):
    """Operations of one call, micro-batch by micro-batch."""

    def __init__(self, wait_ms: int = 0):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "state string, version long")
        self.held = handle.getListState("held", "stream string, seq long, request_id long, message string, full_output binary")

    def _run(self, key: str, ops: list[tuple]) -> pd.DataFrame:
        stored = self.call.get() if self.call.exists() else (None, 0)
        call, version, out = lc.Call(stored[0]), stored[1], []
        for stream, seq, request, message, full in sorted(ops, key=lambda x: x[:2]):
            version, rows = lc.changed(call, version, key, stream, seq, request, message, full)
            out += rows
        if call.state is not None:
            self.call.update((call.stored(), version))
        return pd.DataFrame(out, columns=lc.NAMES).astype(object).where(lambda x: x.notna(), None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ops = [tuple(None if v is None or v != v else int(v) if c in ("seq", "request_id") else v for c, v in zip(_COLUMNS, r, strict=True)) for pdf in rows for r in pdf[_COLUMNS].itertuples(index=False)]
        began = self.call.exists() or any(json.loads(o[3])["operation"] == "begin_call" for o in ops)
        if not began and self.wait_ms:
            for o in ops:
                self.held.appendValue(o)
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            yield pd.DataFrame([], columns=lc.NAMES)
            return
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        if held:
            self.held.clear()
            first = [o for o in ops if json.loads(o[3])["operation"] == "begin_call"][:1]
            yield self._run(key[0], first)  # the call, then what waited for it, then the rest
            yield self._run(key[0], held)
            ops = [o for o in ops if o is not first[0]]
        yield self._run(key[0], ops)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        self.held.clear()
        yield self._run(key[0], held)

    def close(self) -> None:
        pass


def changes(operations: DataFrame, wait_ms: int = 0) -> DataFrame:
    """``lifecycle.changes`` of a stream of operations."""
    return operations.groupBy("call_key").transformWithStateInPandas(statefulProcessor=Applier(wait_ms), outputStructType=lc.CHANGES, outputMode="Append", timeMode="ProcessingTime" if wait_ms else "None")


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, wait_ms: int = 0, files_per_batch: int | None = None):
    """A query that follows a folder of length-prefixed streams and appends their changes to ``table``.

    It ends with what is there, or, where operations may wait (their timers need the clock), goes on until it is stopped.
    """
    spark.conf.set(STORE, ROCKS)
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    streams = source.load(folder).select(F.col("path").alias("stream"), "content")
    rows = changes(frames.decoded(streams).where("fault is null").drop("fault").withColumn("full_output", F.lit(None).cast("binary")), wait_ms)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return rows.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(**({"processingTime": "1 second"} if wait_ms else {"availableNow": True})).start()


def read(spark: SparkSession, table: str) -> DataFrame:
    """The changes of all micro-batches."""
    return spark.read.schema(lc.CHANGES).parquet(f"{table}/batch=*")
