"""Shards of near-equal size: sampled splitters, and ranges of keys subdivided where they are overfull.

Records are ordered by their key, and where keys repeat by a number that each record got when it was
written, so that any range of more than one record can be cut, whatever group of copies fills it. A
sample of the records, drawn by weight (the chance of a draw grows with the size), gives quantiles
that cut the order into ranges of near-equal size. The ranges are then measured over all records. Those
that hold too much or too many, or in which a border between shards falls, are subdivided by a sample of
their own, until every border lies within ``TOLERANCE`` of a shard's share or one record wide. Shards are
runs of whole ranges, so they are ranges of keys themselves; in a shard, slots go by key, without gaps.
Native DataFrame operations only.

At scale: records are written once, with the columns that the caller passes; each round scans keys and sizes only,
and sums by range before anything is shuffled. The driver holds the splitters, the sample that they come from
(``DRAWS`` for each range: bounded, not growing with the records) and a sum for each range. Slots are numbered
in each range by itself: no task sorts more than a range, and no range holds more than a few times the
mean of either bytes or records.

Edge cases: null keys stand before all others; equal keys and equal records are cut like any; a record larger than
a shard's share has a range of its own, and shards near it may be empty; null sizes count as none; an empty table gives
no rows; columns of the input that clash with the result's names are replaced, others stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import Workspace, free_names

#: Ranges of the first cut for each shard; more where there are more than ``RECORDS`` records for each, up to ``MOST``.
RANGES, RECORDS, MOST = 16, 100_000, 8192
#: Draws of the sample for each range that is to be made.
DRAWS = 16
#: How far a border between shards may lie from where it should, as a share of a shard.
TOLERANCE = 0.0005
#: Times the mean range, in bytes or in records, from which on one is overfull.
OVERFULL = 4
#: Pieces into which a range is cut that has a border inside.
PIECES = 32
#: Rounds of subdivision; each makes the ranges in question some ten times smaller.
ROUNDS = 24
_LEAST = -(1 << 63)


def _longs(values: list[int]) -> Column:
    """An array of the plan, made once: values as one text, parsed where constants are folded."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _placed(rows: DataFrame, key: str, rid: str, splitters: list[tuple[int, int]], name: str) -> DataFrame:
    """``rows`` with the number of the range that each is in: how many splitters are not beyond it, by binary search."""
    if not splitters:
        return rows.withColumn(name, F.lit(0))
    power, high = len(splitters).bit_length(), (1 << 63) - 1
    padded = splitters + [(high, high)] * ((1 << power) - 1 - len(splitters))
    keys, ids = _longs([k for k, _ in padded]), _longs([r for _, r in padded])

    def step(at: Column, by: Column) -> Column:
        k, r = F.get(keys, at + by - 1), F.get(ids, at + by - 1)
        return F.when((k < F.col(key)) | ((k == F.col(key)) & (r <= F.col(rid))), at + by).otherwise(at)

    return rows.withColumn(name, F.aggregate(F.array(*[F.lit(1 << p) for p in reversed(range(power))]), F.lit(0), step))


def _draws(rows: DataFrame, key: str, rid: str, expected: Column, seed: int) -> list[tuple[int, int, int]]:
    """(key, id, draws) of a sample in which each record is drawn ``expected`` times on average; the same on every run."""
    chance = F.shiftrightunsigned(F.xxhash64(F.col(rid), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    drawn = rows.select(F.col(key).alias("k"), F.col(rid).alias("r"), F.floor(expected + chance).alias("n")).where("n > 0")
    return sorted((x["k"], x["r"], x["n"]) for x in drawn.collect())


def _quantiles(drawn: list[tuple[int, int, int]], pieces: int) -> list[tuple[int, int]]:
    """At most pieces - 1 records that cut the sample into equal parts."""
    total, so_far, found = sum(n for *_, n in drawn), 0, []
    for k, r, n in drawn:
        if so_far and so_far * pieces // total != (so_far + n) * pieces // total:
            found.append((k, r))
        so_far += n
    return found


def _measured(placed: DataFrame, size: str, name: str) -> dict[int, tuple[int, int]]:
    """(bytes, records) of each range that has any."""
    return {x[0]: (x[1], x[2]) for x in placed.groupBy(name).agg(F.sum(size), F.count("*")).collect()}


def shard(spark: SparkSession, records: DataFrame, shards: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """``records`` with shard (0 to shards - 1) and slot (from 0 in each shard).

    key: a column of integers; size: one of non-negative integers. All columns of ``records`` travel, so pass the
    texts only where shards are to hold them.
    """
    work = Workspace(spark, "sharding")
    kept = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    k, rid, own, rng = free_names(kept, "key_", "rid_", "size_", "range_")
    rows = records.select(*[F.col(f"`{c}`") for c in kept]).withColumns(
        {k: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LEAST)), own: F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), rid: F.monotonically_increasing_id()}
    )
    rows = work.write(rows, "records")
    total, count = rows.agg(F.coalesce(F.sum(own), F.lit(0)), F.count("*")).first()
    narrow = rows.select(k, rid, own)
    if not total:  # of no size at all: each as large as another
        narrow, total = narrow.withColumn(own, F.lit(1).cast("long")), max(count, 1)
    ranges = min(MOST, max(RANGES * shards, count // RECORDS))
    splitters = _quantiles(_draws(narrow, k, rid, F.col(own) * (ranges * DRAWS / total), 0), ranges)
    for turn in range(1, ROUNDS + 1):
        placed = _placed(narrow, k, rid, splitters, rng)
        found = _measured(placed, own, rng)
        cut = _to_cut(found, total, count, ranges, shards)
        if not cut:
            break
        pieces = _longs([cut.get(i, 0) for i in range(len(splitters) + 1)])
        of = lambda j: F.get(_longs([found[i][j] if i in cut else 1 for i in range(len(splitters) + 1)]), F.col(rng))  # noqa: E731, B023
        share = (F.col(own) / F.greatest(of(0), F.lit(1)) + 1 / of(1)) / 2  # by bytes and by records, either of which may be too many
        some = placed.where(F.get(pieces, F.col(rng)) > 0)
        drawn = _draws(some, k, rid, share * F.get(pieces, F.col(rng)) * DRAWS, turn)
        splitters = sorted({*splitters, *_subdivided(drawn, splitters, cut)})
    first, to = _laid_out(found, total, shards, len(splitters) + 1)
    placed = _placed(rows, k, rid, splitters, rng)
    number = F.row_number().over(Window.partitionBy(rng).orderBy(k, rid)).cast("long") - 1
    result = placed.withColumn("slot", F.get(_longs(first), F.col(rng)) + number).withColumn("shard", F.get(_longs(to), F.col(rng)).cast("int"))
    return result.select(*[F.col(f"`{c}`") for c in kept], "shard", "slot")


def _to_cut(found: dict, total: int, count: int, ranges: int, shards: int) -> dict[int, int]:
    """Into how many pieces which ranges are to be cut."""
    cut, before = {}, 0
    for i in sorted(found):
        inside, n = found[i]
        if n > 1:
            fold = max(inside * ranges / total, n * ranges / count if n > RECORDS else 0)
            border = -(-before * shards // total) * total // shards
            off = min(border - before, before + inside - border) if before < border < before + inside else 0
            if inside * shards > total:
                off = inside
            if off * shards > TOLERANCE * total:
                cut[i] = max(PIECES, int(2 * fold))
            elif fold > OVERFULL:
                cut[i] = int(2 * fold)
        before += inside
    return cut


def _subdivided(drawn: list[tuple[int, int, int]], splitters: list[tuple[int, int]], cut: dict[int, int]) -> list[tuple[int, int]]:
    """New splitters of the ranges to cut, each from its own part of the sample."""
    out, own, i = [], [], 0
    for x in [*drawn, None]:
        while own and (x is None or i < len(splitters) and splitters[i] <= x[:2]):
            out += _quantiles(own, cut[i])
            own = []
        if x is not None:
            while i < len(splitters) and splitters[i] <= x[:2]:
                i += 1
            own.append(x)
    return out


def _laid_out(found: dict, total: int, shards: int, n: int) -> tuple[list[int], list[int]]:
    """The first slot of each range, and its shard: that in which its middle falls."""
    first, to, before, slot, now = [0] * n, [0] * n, 0, 0, 0
    for i in range(n):
        inside, records = found.get(i, (0, 0))
        goes = min(shards - 1, (2 * before + inside) * shards // (2 * total))
        if goes != now:
            now, slot = goes, 0
        first[i], to[i] = slot, now
        before, slot = before + inside, slot + records
    return first, to


def write(spark: SparkSession, records: DataFrame, path: str, shards: int, key: str = "doc_id", size: str = "size", per_file: int = 1_000_000) -> None:
    """The shards as Parquet, a folder ``shard=N`` for each, in files of ``per_file`` consecutive slots in order."""
    (part,) = free_names(records.columns, "part_")
    rows = shard(spark, records, shards, key, size).withColumn(part, F.floor(F.col("slot") / per_file))
    rows.repartition("shard", part).sortWithinPartitions("shard", "slot").drop(part).write.partitionBy("shard").parquet(path)
