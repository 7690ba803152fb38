"""Rows that hold whole bodies, through Python a row at a time: a worker holds a batch and a piece of what came out, each bounded in bytes.

Spark bounds the bytes of a batch that goes to a worker, by 64 MB; what comes back is the worker's own to bound: unpacked bodies may be many
times their batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch, and what Spark allows by default.
BYTES, DEFAULT = 4 << 20, "67108864b"
_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound(spark: SparkSession) -> None:
    """Bound the bytes of the batches of this session, unless it has set its own bound."""
    if spark.conf.get(_CONF) == DEFAULT:
        spark.conf.set(_CONF, str(BYTES))


def pieces(batches: Iterable[pa.RecordBatch], one: Callable[..., Iterable[tuple]], schema: pa.Schema, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows that ``one`` makes of each row's values, handed on as soon as their texts and bodies hold so many bytes."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    rows, size = [], 0
    for b in batches:
        for values in zip(*b.columns, strict=True):
            for row in one(*(v.as_py() for v in values)):
                rows.append(row)
                size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
                if size >= most:
                    yield made(rows)
                    rows, size = [], 0
    if rows:
        yield made(rows)


def each(rows: DataFrame, one: Callable[..., Iterable[tuple]], schema: pa.Schema) -> DataFrame:
    """``one`` over all rows: it takes their columns and gives rows of the schema (strings, longs and binaries)."""
    bound(rows.sparkSession)
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return rows.mapInArrow(lambda batches: pieces(batches, one, schema), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
