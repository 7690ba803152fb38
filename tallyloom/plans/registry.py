"""The queries of the engine, by name, with their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.dialect import DUCK, SPARK
from tallyloom.plans import library, programs, reports  # noqa: F401  library adds its queries to those of programs

TABLES = ("documents", "labels", "conversations", "events", "pages")


#: Plans that work on every line of every text: a table of few files is dealt out to all cores first.
PER_LINE = {"r3_line_classes", "r11_context", "r14_first_examples", "w4_context_groups", "q2_search", "a7_properties", "o4_first_matches"}


def dealt(table: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt out: a file may be one row group, which one task reads as a whole."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if len(table.inputFiles()) < cores else table


def run_plan(spark: SparkSession, sf_dir: str, make: Callable, deal: bool = False) -> DataFrame:
    """A plan's SQL over the tables of a folder; views carry the folder in their names, so runs never meet. deal: see ``dealt``."""
    text, tag = make(SPARK), f"{abs(hash(sf_dir)):x}" + "d" * deal

    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (dealt(table) if deal and t == "documents" else table).createOrReplaceTempView(f"{t}_{tag}")
            text = re.sub(rf"\b{t}\b", f"{t}_{tag}", text)
    return spark.sql(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: (lambda spark, sf_dir, make=f, deal=n in PER_LINE: run_plan(spark, sf_dir, make, deal)) for n, f in reports.PLANS.items()}
    return found | programs.QUERIES


def oracle_sql() -> dict[str, str]:
    return {n: f(DUCK) for n, f in reports.PLANS.items()} | programs.ORACLES
