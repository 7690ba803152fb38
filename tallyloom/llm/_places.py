"""Places of rows within a key of any size: a key that holds a large part of all rows is numbered by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import Workspace


def sorting(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def long_keys(work: Workspace, rows: DataFrame, key: str, most: int, size: Column | None = None, most_size: int = 0) -> DataFrame | None:
    """The keys of more than ``most`` rows (or more than ``most_size`` in sum), as column ``long_``; None where there are none."""
    sums = [F.count("*").alias("n"), *([F.sum(size).alias("s")] if size is not None else [])]
    found = rows.groupBy(key).agg(*sums).where(F.col("n") > most if size is None else (F.col("n") > most) | (F.col("s") > most_size))
    found = work.write(found.select(F.col(key).alias("long_")), "long_keys")
    return None if found.isEmpty() else found


def numbered(work: Workspace, rows: DataFrame, key: str, order: list[str], most: int, name: str = "place") -> DataFrame:
    """``rows`` with each row's place in its key, from 0, by ``order`` (nulls first).

    A key of at most ``most`` rows is numbered by one task. Larger ones are cut into ranges of the order: rows are
    numbered in their range, and the counts of a key's earlier ranges come on top. ``order`` is to tell rows apart,
    or else the same rows must not matter. Null keys are one key.
    """
    large = long_keys(work, rows, key, most)
    plain = F.row_number().over(Window.partitionBy(key).orderBy(*sorting(order))).cast("long") - 1
    if large is None:
        return rows.withColumn(name, plain)
    same = rows[key].eqNullSafe(large["long_"])
    small = rows.join(large, same, "left_anti").withColumn(name, plain)
    by = sorting([key, *order])
    cut = rows.join(large, same, "left_semi").withColumn("id_", F.monotonically_increasing_id())
    cut = work.write(cut, "cut")
    dealt = cut.repartitionByRange(*by, "id_").sortWithinPartitions(*by, "id_").drop("id_").withColumn("at_", F.monotonically_increasing_id())
    dealt = work.write(dealt, "dealt").withColumn("part_", F.shiftright("at_", 33))
    # a key's first row in a range, and how many it has in earlier ranges: a row for each range and key
    spans = dealt.groupBy(key, "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col(key).alias("key_"), F.col("part_").alias("of_"), (before - F.col("first_")).alias("shift_"))
    met = dealt.join(spans, dealt[key].eqNullSafe(spans["key_"]) & (dealt["part_"] == spans["of_"]))
    return small.unionByName(met.withColumn(name, F.col("at_") + F.col("shift_")).select(*rows.columns, name))
