"""The frame of a record stream as an automaton, run over parts of a stream at a time.

A stream opens with ``stream_start``, may name roots, holds sources one after the other (``source_start``, records, then commit or rollback) and
closes with ``stream_end``. A record maps each place that a stream can be in to the next; a run of records maps places
to places likewise (``run``). A kind of record leads to one place alone, or breaks the stream: so where a stream stands follows from the record before,
and it is broken from the first record on that has no business after that one. A stream is cut into parts of ``PART`` places of its order; windows over
the parts look back by a record, and a window over a stream's parts (a short row for each) says what stood before each part and whether the stream
was whole. No window holds more than a part's records, or a stream's parts. Nothing after a breach counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values. Places: before the start, between sources, in a source, after the end, broken.
FRESH, IDLE, INSIDE, DONE, BROKEN = range(5)
CONTENT = ("source_item", "reset_source", "session", "tool_call", "tool_result", "observation", "issue")
KINDS = {"stream_start": 0, "stream_end": 1, "source_start": 2, "source_commit": 3, "source_rollback": 3, "source_root": 4, **dict.fromkeys(CONTENT, 5)}
NEXT = [
    [IDLE, BROKEN, BROKEN, BROKEN, BROKEN],  # stream_start
    [BROKEN, DONE, BROKEN, BROKEN, BROKEN],  # stream_end
    [BROKEN, INSIDE, BROKEN, BROKEN, BROKEN],  # source_start
    [BROKEN, BROKEN, IDLE, BROKEN, BROKEN],  # source_commit, source_rollback
    [BROKEN, IDLE, BROKEN, BROKEN, BROKEN],  # source_root
    [BROKEN, BROKEN, INSIDE, BROKEN, BROKEN],  # records of a source
    [BROKEN] * 5,  # anything else
]
#: The one place that a kind leads to, wherever it may stand.
LEADS = [min(row) for row in NEXT]
FAULTS = ["unexpected stream start", "unexpected stream end", "unexpected source start", "no active source to end", "source root outside the header", "record outside a source", "unknown record"]
#: Records of a part.
PART = 4096


_TABLE = np.array(NEXT, np.int64)


def _kind() -> Column:
    out = F.lit(len(NEXT) - 1)
    for name, k in KINDS.items():
        out = F.when(F.col("record") == name, k).otherwise(out)
    return out


def run(kinds: np.ndarray) -> np.ndarray:
    """The map of a run of kinds: where each place leads. Runs compose: the map of two is ``second[first]``."""
    places = np.arange(5)
    for k in kinds:
        places = _TABLE[k][places]
        if (places == BROKEN).all():
            break
    return places


def _leads(before: Column) -> Column:
    """Where the kind of the record before leads, if its stream isn't broken. Nothing before: FRESH."""
    leads = F.array(*[F.lit(k) for k in LEADS])
    return F.coalesce(F.get(leads, before.cast("int")), F.lit(FRESH))


def _next(kind: Column, place: Column) -> Column:
    return F.get(F.flatten(F.array(*[F.array(*map(F.lit, row)) for row in NEXT])), (kind * 5 + place).cast("int"))


def placed(frames: DataFrame, part: int = PART) -> DataFrame:
    """frames (stream, seq, record and more) with kind, place (where the stream stands), after (where it then stands) and source (its number in the stream).

    seq says the order and isn't to repeat in a stream; its gaps only make parts smaller.
    """
    rows = frames.withColumns({"stream": F.col("stream").cast("string"), "seq": F.col("seq").cast("long"), "_kind": _kind().cast("long"), "_part": F.floor(F.col("seq") / part)})
    rows = rows.where("stream is not null and seq is not null")
    inside, over = Window.partitionBy("stream", "_part").orderBy("seq"), Window.partitionBy("stream").orderBy("_part")
    rows = rows.withColumns({"_before": F.lag("_kind").over(inside), "_starts": F.count_if(F.col("_kind") == 2).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    stands = lambda before: _leads(F.col(before))
    breaks = F.when(F.col("_before").isNotNull() & (_next(F.col("_kind"), stands("_before")) == BROKEN), F.col("seq"))
    parts = rows.groupBy("stream", "_part").agg(
        F.min("seq").alias("begin"), F.min_by("_kind", "seq").alias("first"), F.max_by("_kind", "seq").alias("last"), F.count_if(F.col("_kind") == 2).alias("starts"), F.min(breaks).alias("breach")
    )
    parts = parts.withColumns({"_entry": F.lag("last").over(over), "_earlier": F.coalesce(F.sum("starts").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    own = F.when(_next(F.col("first"), stands("_entry")) == BROKEN, F.col("begin")).otherwise(F.col("breach"))
    parts = parts.select("stream", "_part", "_entry", "_earlier", F.min(own).over(over).alias("_breach"))
    met = rows.join(parts, ["stream", "_part"])
    before = _leads(F.coalesce("_before", "_entry"))
    place = F.when(F.col("_breach") < F.col("seq"), BROKEN).otherwise(before)
    after = F.when(F.col("_breach") <= F.col("seq"), BROKEN).otherwise(_next(F.col("_kind"), before))
    return met.select(*frames.columns, F.col("_kind").alias("kind"), place.cast("long").alias("place"), after.cast("long").alias("after"), (F.col("_starts") + F.col("_earlier")).alias("source"))


def faults(rows: DataFrame) -> DataFrame:
    """stream, seq, fault of the streams (``placed``) that break: the first record that has no business where it stands, or how the stream ends (no seq)."""
    first = rows.where((F.col("place") != BROKEN) & (F.col("after") == BROKEN)).groupBy("stream").agg(F.min_by(F.struct("seq", "kind", "place"), "seq").alias("f"))
    inside_end = (F.col("f.kind") == 1) & (F.col("f.place") == INSIDE)
    named = F.when(inside_end, "stream ended before its source committed").otherwise(F.get(F.array(*[F.lit(x) for x in FAULTS]), F.col("f.kind").cast("int")))
    last = rows.groupBy("stream").agg(F.max_by("after", "seq").alias("end"))
    torn = last.where(~F.col("end").isin(DONE, BROKEN)).select("stream", F.lit(None).cast("long").alias("seq"), F.when(F.col("end") == INSIDE, "stream ended with an active source").otherwise("stream ended without a completion record").alias("fault"))
    return first.select("stream", F.col("f.seq").alias("seq"), named.alias("fault")).unionByName(torn)


def committed(rows: DataFrame) -> DataFrame:
    """The records of sources that were committed before their stream broke, and the roots that were named before it did."""
    done = rows.where((F.col("record") == "source_commit") & (F.col("place") == INSIDE)).select("stream", "source")
    inside = rows.where((F.col("kind") == 5) & (F.col("place") == INSIDE)).join(done, ["stream", "source"], "left_semi")
    roots = rows.where((F.col("kind") == 4) & (F.col("place") == IDLE))
    return inside.unionByName(roots.select(*inside.columns))
