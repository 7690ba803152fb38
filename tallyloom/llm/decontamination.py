"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased words without ASCII punctuation. A seed is a hash of the tokens at the 1s of a
fixed mask; the 0s are ignored, so a passage with substituted words still meets its item at those
places. The seeds of all benchmark items (test side) are joined in Spark with those of every position of
every text (training side); each hit names a diagonal, on which item and text are compared token by token.
The overlap is the longest stretch of the diagonal with no more than a fifth of its tokens substituted
that begins and ends with an equal token or is the whole item; it counts as contamination from
``LEAST`` tokens on, or as long as the item where that is shorter. The masks meet every such stretch:
one of 13 tokens or more parts into pieces of 13 to 25, one of which has no more than a fifth
substituted, and wherever a piece's substitutions are, some mask finds a place between them.

Before the join the training side passes a bit filter of the test side's seeds (16 bits a seed, 16 MB at
most, whatever the benchmark's size), so few seeds of texts travel: those of hits and one in 16 or less of
the rest. Spark splits seeds that are frequent in the join. Where a text repeats one token over and over, the
places farther than the longest item from both ends of the run are left out: the item meets the same tokens there as at the
places that are kept, so none of them is the first of the longest. Hits meet the texts by doc_id and text hash, in
a broadcast only where their table has no more than ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` (token hashes, which hardly
compress); the driver holds the filter alone.

Edge cases: items of fewer than ``LEAST`` tokens are sought whole, by the masks ``SHORT_MASKS``; those of
fewer than ``SHORT`` match nothing; null and empty texts and items match nothing; rows without doc_id,
repeated rows and repeated items are each reported; of stretches that tie in length the first is; texts are
read whole; an empty benchmark or table gives no rows; other columns are ignored, and kept by ``clean``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._shared import Workspace, tidied
from tallyloom.llm._text import SPACE, Words, chunks, mix, odd_constants

# Fixed values, found by search: 6 positions each, 4 for short items.
MASKS = ("1111011", "110010111", "1011000000111")
SHORT_MASKS = ("1111", "110011")
SHORT, LEAST, PENALTY = 6, 13, 4
#: Bits of the filter, as powers of two: at least, at most; and of a piece of it.
FILTER_LEAST, FILTER_MOST, PIECE = 16, 27, 19
#: Rows of texts with hits that are broadcast (a few items' tokens each); items of a text are in so many rows at most.
BROADCAST_ROWS, SPREAD = 50_000, 8
BROADCAST_BYTES = 16 << 20
_APART = SPACE.copy()
_APART[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _lower(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def words_of(texts: list[str | None]) -> Words:
    return Words([_lower(t) for t in texts], lower=False, apart=_APART)


SHAPES = [np.flatnonzero([c == "1" for c in m]) for m in MASKS + SHORT_MASKS]
SPANS = [len(m) for m in MASKS + SHORT_MASKS]


def seeds(words: np.ndarray, shape: int) -> np.ndarray:
    """Hashes of one mask at every position of the word hashes."""
    n = len(words) - SPANS[shape] + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in zip(SHAPES[shape].tolist(), odd_constants(len(SHAPES[shape]), 77 + shape), strict=True):
        out += words[j : j + n] * c
    return mix(out)


def item_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, their offsets) of an item's word hashes: of the masks for its length."""
    if len(words) < SHORT:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = [seeds(words, s) for s in (range(len(MASKS)) if len(words) >= LEAST else range(len(MASKS), len(SHAPES)))]
    return np.concatenate(found), np.concatenate([np.arange(len(x)) for x in found])


def overlap(words: np.ndarray, own: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first token in the text, length, equal tokens) of the longest stretch of an item on a diagonal, if it counts."""
    a, b = max(0, diagonal), min(len(words), diagonal + len(own))
    equal = words[a:b] == own[a - diagonal : b - diagonal]
    need = min(LEAST, len(own))
    n_equal = int(equal.sum())
    if 5 * n_equal < 4 * need:
        return None
    if len(equal) == len(own) and 5 * n_equal >= 4 * len(own):
        return a, len(own), n_equal
    run = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    at = np.flatnonzero(equal)
    reach = np.maximum.accumulate(run[at + 1][::-1])[::-1]  # the most of any end from here on
    last = np.searchsorted(-reach, -run[at], side="right") - 1  # the last end not below each begin
    size = at[last] + 1 - at
    k = int(np.argmax(size))
    if size[k] < need:
        return None
    return a + int(at[k]), int(size[k]), int(last[k]) - k + 1


@tidied
def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, tokens): an item's word hashes."""
    for b in batches:
        w = words_of(b.column("text").to_pylist())
        rows = [w.hashes[x:y].tobytes() for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(rows, pa.binary())], names=["item_id", "tokens"])


@tidied
def _test_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item, offset) of items."""
    for b in batches:
        for item, raw in zip(b.column("item").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            h, offset = item_seeds(np.frombuffer(raw, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item)), pa.array(offset)], names=["seed", "item", "offset"])


def _piece(table: pa.Table) -> pa.Table:
    """A piece of the filter, as bits, from the slots that are taken in it."""
    bits = np.zeros(1 << PIECE, bool)
    bits[np.asarray(table.column("slot")) & ((1 << PIECE) - 1)] = True
    return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word where the run of equal words that it is in begins, and where it ends; runs end with their text (first: where texts begin)."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = words[1:] != words[:-1]
    new[first[first < n]] = True
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return starts[which], np.append(starts[1:], n)[which]


def _training_side(power: int, taken: np.ndarray, longest: int):
    """(doc_id, text_key, seed, place) of texts' seeds that pass the filter, but for those deep inside a run of one word. longest: tokens of an item."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [_lower(t) for t in b.column("text").to_pylist()]
            for a, z in chunks(low):
                w = Words(low[a:z], lower=False, apart=_APART)
                begin, end = runs(w.hashes, w.first)
                found = []
                for s in range(len(SHAPES)):
                    x = seeds(w.hashes, s)
                    slot = (x >> np.uint64(64 - power)).astype(np.int64)
                    at = np.flatnonzero(taken[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                    text = np.searchsorted(w.first, at, side="right") - 1
                    inside = (at + SPANS[s] <= w.first[text + 1]) & ((at - begin[at] <= longest) | (end[at] - at - SPANS[s] <= longest))
                    at, text = at[inside], text[inside]
                    found.append((x[at].view(np.int64), text, at - w.first[text]))
                h, text, place = (np.concatenate(v) for v in zip(*found, strict=True))
                if len(h):
                    row = pa.array(a + text)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("text_key").take(row), pa.array(h), pa.array(place)], names=["doc_id", "text_key", "seed", "place"])

    return run


FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "start", "length", "n_equal", "item_tokens")])
_KEYED = T.StructType([*FOUND, T.StructField("text_key", T.LongType())])


@tidied
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest overlap of each text and each of its items with hits."""
    for b in batches:
        out = []
        for doc, key, text, items in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text_key", "text", "items")), strict=True):
            words = words_of([text]).hashes
            for x in items:
                own = np.frombuffer(x["tokens"], np.uint64)
                found = [got for d in x["diagonals"] if (got := overlap(words, own, d))]
                if found:
                    start, length, equal = min(found, key=lambda g: (-g[1], g[0]))
                    out.append((doc, x["item_id"], start, length, equal, len(own), key))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_KEYED.names)


def _overlaps(work: Workspace, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminated`` with text_key (xxhash64 of the text), written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(_tokens, "item_id long, tokens binary").withColumn("item", F.monotonically_increasing_id())
    items = work.write(items, "items")
    tests = work.write(items.mapInArrow(_test_side, "seed long, item long, offset long"), "tests")
    power = min(FILTER_MOST, max(FILTER_LEAST, (16 * tests.count()).bit_length()))
    slots = tests.select(F.expr(f"shiftrightunsigned(seed, {64 - power})").alias("slot")).distinct().withColumn("piece", F.shiftright("slot", PIECE))
    taken = np.zeros(max(1 << PIECE, 1 << power) >> 3, np.uint8)
    for r in slots.groupBy("piece").applyInArrow(_piece, "piece long, bits binary").collect():  # 16 MB at most
        taken[r["piece"] << PIECE >> 3 : (r["piece"] + 1) << PIECE >> 3] = np.frombuffer(r["bits"], np.uint8)
    longest = (items.agg(F.max(F.octet_length("tokens"))).first()[0] or 0) // 8
    hits = rows.mapInArrow(_training_side(power, taken, longest), "doc_id long, text_key long, seed long, place long").join(tests, "seed")
    hits = hits.groupBy("doc_id", "text_key", "item").agg(F.array_sort(F.collect_set(F.col("place") - F.col("offset"))).alias("diagonals"))
    hits = hits.join(items, "item").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(SPREAD)))
    hits = hits.groupBy("doc_id", "text_key", "part").agg(F.collect_list(F.struct("item_id", "tokens", "diagonals")).alias("items"))
    hits = work.write(hits.select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "items"), "hits")
    if work.size("hits") <= BROADCAST_BYTES and hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    met = rows.join(hits, rows["doc_id"].eqNullSafe(hits["id_"]) & (rows["text_key"] == hits["key_"])).select("doc_id", "text_key", "text", "items")
    found = work.write(met.mapInArrow(_verified, _KEYED), "found")
    work.keep("found")
    return found


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, length, n_equal, item_tokens) of every text and item that overlap; tokens count from 0."""
    return _overlaps(Workspace(spark, "contaminated"), docs, benchmark).select(*FOUND.names)


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item."""
    work = Workspace(spark, "clean")
    gone = _overlaps(work, docs, benchmark).select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).distinct()
    gone = work.write(gone, "gone")
    work.keep("gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = docs["doc_id"].cast("long").eqNullSafe(gone["id_"]) & (F.xxhash64(docs["text"].cast("string")) == gone["key_"])
    return docs.join(gone, same, "left_anti")
