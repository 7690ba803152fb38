"""Many small records in one Arrow value: integer columns as differences, byte plane by byte plane.

Planes of high bytes are nearly all zero and vanish in the shuffle's compression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def put(values: np.ndarray, delta: bool = True) -> bytes:
    v = np.ascontiguousarray(values, dtype="<i8")
    if delta and len(v):
        v = np.diff(v, prepend=v.dtype.type(0))
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes()


def get(raw: bytes, delta: bool = True) -> np.ndarray:
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return np.cumsum(v) if delta else v


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def buckets(df: DataFrame, each: int, least: int = 32) -> int:
    """A number of hash buckets for an input: its size by Spark's estimate, ``each`` bytes to a bucket."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:  # not known: plan for full shuffle partitions
        return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // each))
