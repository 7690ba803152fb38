"""URL filters by host-suffix and path-prefix expressions.

Every url expands into the combinations of its host's suffixes (at label borders) with its path's
prefixes. Only suffix depths and prefix lengths that occur in the rules are made, so a url of any
length gives a number of expressions fixed by the rule set. Expressions and rules meet in an
equi-join on the first 32 bits of SHA-256; full digests then confirm the hit, and the longest rule
wins (host plus path, then the rule that blocks). Native DataFrame operations only.

Distinct pairs of host and path are judged once, so a hot url costs one row; pairs that a rule fits are
written, and every row looks its verdict up there.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets the
default verdict; urls are read whole; rules that tie in length and verdict are told apart by their text;
rows with null ids and repeated rows each get their verdict; an empty table gives no rows and an empty
rule table the default; columns of the input that clash with the result's names are replaced by the
result's, others are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._shared import Workspace, free_names

#: Verdicts of distinct host and path that are broadcast (a few hundred bytes each); beyond, Spark shuffles both sides and splits hot urls.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (ASCII lower case) and path."""
    u = F.col(f"`{url}`").cast("string")
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.char_length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows (rule, verdict, host, path, digest, short) of (verdict, 'host/path') pairs."""
    fields = lambda v, r: zip(("rule", "verdict", "rule_host", "rule_path"), (r, v, r.partition("/")[0], "/" + r.partition("/")[2]))
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in fields(v, r)]) for v, r in rules])
    table = spark.range(1).select(F.inline(rows))
    return table.withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256)).withColumn(
        "short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict.

    rules: as ``rule_table`` makes them. Distinct urls are judged once, and the shape of the rule
    set (label depths, path lengths: a few numbers) is read by the driver.
    """
    shape = rules.select(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("depths"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parts = with_parts(pages.select(*[F.col(f"`{c}`") for c in kept]), url)
    ints = lambda xs: F.array(*[F.lit(int(x)) for x in xs]) if xs else F.expr("cast(array() as array<int>)")
    keys = parts.select("host", "path").where("host <> '' and path <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(ints(shape["depths"]), lambda d: d <= F.size(labels)),
        lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."),
    )
    prefixes = F.transform(
        F.filter(ints(shape["lengths"]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    made = keys.select("host", "path", F.explode(F.array_distinct(both)).alias("_expr"))
    made = made.withColumn("_digest", F.sha2("_expr", 256)).withColumn(
        "_short", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long")
    )
    r = rules.select("rule", F.col("verdict").alias("_v"), "digest", "short")
    hits = made.join(r, (made["_short"] == r["short"]) & (made["_digest"] == r["digest"]))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), (F.col("_v") == "block").alias("b"), "rule", F.col("_v").alias("v"))).alias("_b")
    )
    rule_, verdict_, host_, path_ = free_names(kept + ["host", "path"], "rule_", "verdict_", "host_", "path_")
    best = best.select(F.col("host").alias(host_), F.col("path").alias(path_), F.col("_b.rule").alias(rule_), F.col("_b.v").alias(verdict_))
    best = Workspace(pages.sparkSession, "urls").write(best, "best")
    if best.count() <= BROADCAST_ROWS:
        best = F.broadcast(best)
    judged = parts.join(best, (parts["host"] == best[host_]) & (parts["path"] == best[path_]), "left")
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col(rule_).alias("rule"), F.coalesce(verdict_, F.lit(default)).alias("verdict"))
