"""Connected components of an edge list, by alternating large and small stars.

Each round links every node's larger neighbours to its least one, then its smaller ones likewise;
rounds end when nothing changes (a number of rounds that grows with the logarithm of the longest
path). Every round is written to the shared folder, so a lost executor costs one round at most. The
driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import Workspace


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node with an edge (a, b); component: the least node reachable. Null ends are left out."""
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = work.write(e, f"{name}_0")
    r, state = 0, None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        r += 1
        after = work.write(small.where("u <> v").distinct(), f"{name}_{r}")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if r > 1:
            work.drop(f"{name}_{r - 1}")
        current = after
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
