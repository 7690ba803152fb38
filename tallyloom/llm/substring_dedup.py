"""Removal of repeated passages: every window of ``WINDOW`` words that also starts earlier goes.

Each task takes Rabin-Karp hashes (polynomials over 64-bit word hashes, modulo 2**64, then mixed) of
all windows of its texts. Of a window that repeats within a task only the first start can be the
corpus's first, so the others are marked there and then, and one start of each distinct window goes
to the window's hash bucket; a passage that a third of all rows share reaches its bucket once for
each task. A bucket's task finds, for every hash, the least (doc_id, start); all other starts are
marked. Marks meet by document and merge into maximal word intervals [from, to).

Windows are equal when their 64-bit hashes are and their buckets, which come from hashes to another base, are:
so the bits that tell windows apart grow with the input (by 25 at 100 TB, where less than one false
pair is to be expected).

Starts travel as packed columns of about ten bytes a window. The intervals (a few for each document
with repeats) meet the texts in a join that is a broadcast only when their table, as written, is
smaller than ``BROADCAST`` bytes; else both sides are shuffled.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.

Edge cases: a null text has no words; a null doc_id comes after all others; equal windows at equal
starts of rows that repeat a doc_id are not earlier than one another; marks of such rows (and of those
without id) carry their text's hash as ``variant``, so that each text loses its own words only; texts
shorter than a window keep all words; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._blobs import buckets, get, put, runs
from tallyloom.llm._shared import Workspace, free_names, tidy
from tallyloom.llm._text import Words, chunks, mix, utf8

WINDOW, FLUSH, BUCKET_BYTES, BROADCAST = 20, 1_000_000, 3_000_000, 32 << 20
LAST = 2**63 - 1
BASE, BUCKET_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


@functools.lru_cache(4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x))
    return tuple(out)


def window_hashes(words: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all windows of k words: differences of one running polynomial, shifted back."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(16, int(len(words)).bit_length()), base)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down[: len(words)])])
    return mix((running[k:] - running[:-k]) * up[:n])


def windows(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, hashes, 32 bits of others, text of each window, start of each window) for blocks of texts."""
    for a, b in chunks(texts):
        w = Words(texts[a:b], lower=False)
        h = window_hashes(w.hashes, k)
        count = np.maximum(np.diff(w.first) - k + 1, 0)
        doc = np.repeat(np.arange(b - a), count)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = w.first[doc] + start
        other = (window_hashes(w.hashes, k, BUCKET_BASE) >> np.uint64(32)).astype(np.uint32)
        yield a, h[at], other[at], doc, start


_MARKS = ("hashes", "docs", "variants", "counts", "starts", "gone_docs", "gone_variants", "gone_counts", "gone_starts")
_SENT = T.StructType([T.StructField("bucket", T.IntegerType())] + [T.StructField(n, T.BinaryType()) for n in _MARKS])


def _runs(doc: np.ndarray, variant: np.ndarray | None) -> np.ndarray:
    """Where the document or the variant changes, and the length at the end."""
    return runs(doc) if variant is None else np.union1d(runs(doc), runs(variant))


def _by_doc(doc: np.ndarray, variant: np.ndarray | None, start: np.ndarray) -> list[bytes]:
    """Packed (documents, variants, counts, starts) of entries sorted by document and start."""
    r = _runs(doc, variant)
    return [put(doc[r[:-1]]), b"" if variant is None else put(variant[r[:-1]], delta=False), put(np.diff(r), delta=False), put(start)]


def _spread(docs: bytes, variants: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, counts = get(docs), get(counts, delta=False)
    variants = get(variants, delta=False) if variants else np.zeros(len(docs), np.int64)
    return np.repeat(docs, counts), np.repeat(variants, counts), get(starts)


def _sender(k: int, n_buckets: int):
    def flush(parts: list) -> pa.RecordBatch:
        columns = list(zip(*parts, strict=True))
        parts.clear()
        h, other, doc, start = (np.concatenate(columns[i]) for i in range(4))
        variant = np.concatenate([np.zeros(len(x), np.int64) if v is None else v for x, v in zip(columns[0], columns[4], strict=True)]) if any(v is not None for v in columns[4]) else None
        del columns
        pick = lambda x, o: None if x is None else x[o]
        order = np.lexsort((start, doc)) if variant is None else np.lexsort((variant, start, doc))
        h, other, doc, start, variant = h[order], other[order], doc[order], start[order], pick(variant, order)
        by_hash = np.argsort(h, kind="stable")  # equal hashes stay in order of (doc, start, variant)
        r = runs(h[by_hash])
        lead = np.repeat(by_hash[r[:-1]], np.diff(r))  # each entry's first, in order of hashes
        later = np.zeros(len(h), bool)
        later[by_hash] = (doc[by_hash] != doc[lead]) | (start[by_hash] != start[lead])
        first = ~later  # of each variant one
        again = np.diff(h[by_hash]) == 0
        first[by_hash[1:][again if variant is None else again & (np.diff(variant[by_hash]) == 0)]] = False
        del by_hash, lead, again
        bucket = (other % np.uint32(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = runs(bucket[order])
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            o = order[a:b]
            f, g = o[first[o]], o[later[o]]
            rows.append((int(bucket[o[0]]), h[f].tobytes(), *_by_doc(doc[f], pick(variant, f), start[f]), *_by_doc(doc[g], pick(variant, g), start[g])))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], names=_SENT.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            ids, variants = b.column("doc_id").to_numpy(), b.column("variant").to_numpy()
            for first, h, other, doc, start in windows(utf8(b.column("text")), k):
                if len(h):
                    own = variants[first + doc]
                    parts.append((h, other, ids[first + doc], start.astype(np.int32), own if own.any() else None))
                    held += len(h)
                if held >= FLUSH:
                    yield flush(parts)
                    held = 0
        if parts:
            yield flush(parts)
        tidy()

    return run


def _marker(table: pa.Table) -> pa.Table:
    """Of one bucket: (doc_id, variant, starts) of all windows that also start earlier."""
    cols = [table.column(n).to_pylist() for n in _MARKS]
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in cols[0]])
    doc, variant, start = (np.concatenate(x) for x in zip(*(_spread(*x) for x in zip(*cols[1:5], strict=True)), strict=True))
    gone_doc, gone_variant, gone_start = (np.concatenate(x) for x in zip(*(_spread(*x) for x in zip(*cols[5:], strict=True)), strict=True))
    order = np.argsort(h, kind="stable")
    same = h[order]
    twice = np.zeros(len(h), bool)
    equal = same[1:] == same[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    o = order[twice]
    o = o[np.lexsort((start[o], doc[o], h[o]))]
    r = runs(h[o])
    lead = np.repeat(o[r[:-1]], np.diff(r))
    later = o[(doc[o] != doc[lead]) | (start[o] != start[lead])]
    doc, variant, start = (np.concatenate([x, y[later]]) for x, y in ((gone_doc, doc), (gone_variant, variant), (gone_start, start)))
    some = variant.any()
    order = np.lexsort((start, variant, doc)) if some else np.lexsort((start, doc))
    doc, variant, start = doc[order], variant[order], start[order]
    r = _runs(doc, variant if some else None)
    ids = {n: pa.array(x[r[:-1]] if len(x) else x, pa.int64()) for n, x in (("doc_id", doc), ("variant", variant))}
    return pa.table(ids | {"starts": pa.ListArray.from_arrays(pa.array(r, pa.int32()), pa.array(start.astype(np.int32)))})


def _merger(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("starts")
            values, offsets = np.asarray(lists.values)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            order = np.lexsort((values, row))
            values = values[order]
            fresh = np.ones(len(values), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (values[1:] > values[:-1] + k)
            at = np.flatnonzero(fresh)
            last = np.concatenate([at[1:], [len(values)]])[: len(at)] - 1
            per_row = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=b.num_rows))]).astype(np.int32)
            make = lambda v: pa.ListArray.from_arrays(pa.array(per_row), pa.array(v))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("variant"), make(values[at]), make(values[last] + k)], names=["doc_id", "variant", "from", "to"])

    return run


def _keys(docs: DataFrame, work: Workspace) -> tuple[DataFrame, dict[str, Column]]:
    """docs, and each row's doc_id (null: ``LAST``) and variant: of rows whose id others have too (or none), the text's hash, else 0."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    (name,) = free_names(docs.columns, "shared_id")
    shared = docs.select(doc_id.alias(name)).groupBy(name).agg(F.count("*").alias("n_")).where("n_ > 1").select(name)
    shared = work.write(shared, "shared")
    if shared.isEmpty():
        return docs, {"doc_id": doc_id, "variant": F.lit(0).cast("long")}
    if work.size("shared") <= BROADCAST:
        shared = F.broadcast(shared)
    variant = F.when(F.col(name).isNotNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0))
    return docs.join(shared, doc_id == F.col(name), "left"), {"doc_id": doc_id, "variant": variant}


def repeats(docs: DataFrame, keys: dict[str, Column], k: int, n_buckets: int, work: Workspace) -> DataFrame:
    """(doc_id, variant, from, to): the maximal word intervals to remove, of texts that have any."""
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], F.col("text").cast("string").alias("text")).where("text is not null")
    sent = rows.mapInArrow(_sender(k, n_buckets), _SENT)
    marks = sent.groupBy("bucket").applyInArrow(_marker, "doc_id long, variant long, starts array<int>")
    by_doc = marks.groupBy("doc_id", "variant").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return work.write(by_doc.mapInArrow(_merger(k), "doc_id long, variant long, `from` array<bigint>, `to` array<bigint>"), "intervals")


_KEPT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def remove(spark: SparkSession, docs: DataFrame, k: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, n_removed, kept (the words left, by single spaces) and kept_sha256.

    Columns of the input with these names are replaced.
    """
    work = Workspace(spark, "substrings")
    cols = [c for c in docs.columns if c.lower() not in _KEPT.names]
    rows, keys = _keys(docs.select(*[F.col(f"`{c}`") for c in cols]), work)
    n_buckets = buckets(docs.select("doc_id", "text"), BUCKET_BYTES)  # a join's size would be a product
    names = free_names(rows.columns, "id_", "variant_", "from_", "to_")
    id_, variant_, from_, to_ = names
    found = repeats(rows, keys, k, n_buckets, work).toDF(*names)
    work.release()
    if work.size("intervals") <= BROADCAST:
        found = F.broadcast(found)
    joined = rows.join(found, (keys["doc_id"] == F.col(id_)) & (keys["variant"] == F.col(variant_)), "left").select(*[F.col(f"`{c}`") for c in cols], from_, to_)
    schema = T.StructType([docs.schema[c] for c in cols] + list(_KEPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, froms, tos in zip(utf8(b.column("text")), b.column(from_).to_pylist(), b.column(to_).to_pylist(), strict=True):
                words, left = t.split(), None
                if froms:
                    left, at = [], 0
                    for f, e in zip(froms, tos, strict=True):
                        left += words[at:f]
                        at = max(at, e)
                    left += words[at:]
                text = b" ".join(words if left is None else left)
                out.append((len(words), 0 if left is None else len(words) - len(left), text if with_text else None, hashlib.sha256(text).hexdigest()))
            made = list(zip(*out, strict=True)) or [[]] * 4
            columns = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.binary()).cast(pa.string()), pa.array(made[3], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + columns, names=cols + _KEPT.names)

    return joined.mapInArrow(run, schema)
