"""Tokenising and mixture-controlled packing into fixed windows.

``tokenize`` gives each text's ids (exactly what the tokenizer of the file gives), ``pack`` deals
them to windows by deficit round-robin over source queues. In round-robin each queue gains credit in
proportion to its weight and sends a token when its credit reaches half a token; what it holds over
or owes at a window's end is carried to the next. Seen over virtual time t, queue i with weight w_i
has sent min(T_i, floor(w_i * t + 1/2)) tokens, so the carried deficits at any window have a closed
form: a partition that starts at window n solves for the t at which n * size tokens are sent, and
goes on from those deficits. No partition waits for another, and any two agree. A queue that runs
dry leaves its share to the rest, by weight; all windows but the last are full.

Cost: one pass of the texts; the ids stay where they were written and meet only the small table of
queue offsets (one row for each input partition and source). The driver holds one row per queue: one for
each source, or, of more than ``max_sources``, for the largest, and one that all others share.

Edge cases: null and empty texts give the end token alone; a null source is a queue of its own;
repeated rows are packed as often as they occur; ids may be null or tie, the order within a queue is
that of the input; texts are read whole and cut in as many pieces as they need; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._shared import Workspace, tidied, tidy

WINDOW = 4096
#: Words kept in a worker's cache of encoded words (about 150 bytes each), and the length of the longest.
CACHE, LONGEST = 600_000, 64
#: Weights are whole numbers up to this; a tick is the time in which such a queue sends one token.
SCALE = 1 << 16

# Fixed by the tokenizer's own split pattern.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters on whose class libraries differ, or that start special tokens: such texts go through the whole tokenizer.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "᠎", "​", "﻿", "<|")

#: Libraries agree on the classes and cases of letters up to here; words beyond take the whole tokenizer.
_PLAIN = "\u024f"

#: Ends a piece's bytes; never part of UTF-8.
_END = b"\xff"


def _alphabet() -> dict[str, int]:
    """The byte-level files' character for each byte: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTES = _alphabet()


def _raw(token: str) -> bytes:
    return bytes([_BYTES[c] for c in token])


class WordEncoder:
    """Ids of texts by a lower-casing BPE file with word ends, cached by word.

    The file's normaliser and split never join across white space, so a text's ids are those of its
    words in order. Texts with doubtful characters take the tokenizer's own path.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab(with_added_tokens=False)
        ranks = {_raw(t[:-4]) + _END if t.endswith("</w>") and len(t) > 4 else _raw(t): i for t, i in vocab.items()}
        # ids rise in the order of merges, so they serve as ranks
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.findall = regex.compile(_SPLIT).findall
        self.wide = max(self.whole.get_vocab().values()) >= 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.words = _Words(self.word)
        self.signs: dict[str, bytes] = {}  # pieces of one plain character

    def _split(self, word: str) -> list[str]:
        import unicodedata

        w = (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()
        if w.isalpha():
            return [w]
        if w[-1] in ".,!?;:" and w[:-1].isalpha():
            return [w[:-1], w[-1]]
        return self.findall(w)

    def _encoded(self, piece: str) -> bytes:
        return array(self.code, self.piece(piece.encode() + _END)).tobytes()

    def _part(self, piece: str, word: str) -> bytes:
        """Ids of a piece of a word; plain pieces are words themselves and in the words' cache."""
        if len(piece) == 1:
            if piece not in self.signs:
                self.signs[piece] = self._encoded(piece)
            return self.signs[piece]
        return self.words[piece] if piece.isascii() and piece.isalpha() and piece != word else self._encoded(piece)

    def word(self, word: str) -> bytes:
        low = word.lower()
        if low.isalpha() and low.isascii():
            return self._encoded(low)
        if low.isascii() or max(word) <= _PLAIN:
            return b"".join([self._part(p, word) for p in self._split(word)])
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        get = self.words.__getitem__
        return [self._whole(t) if any(map(t.__contains__, _ODD)) else b"".join(map(get, t.split())) for t in texts]


class _Words(dict):
    """Ids by word, worked out when first asked for. When half of ``CACHE`` is full, its words become the older half,
    of which those asked for again come back and the others go at the next turn."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return self.encode(word)
        if 2 * len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        ids = self.older.pop(word, None) or self.encode(word)
        self[word] = ids
        return ids


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _forget() -> None:
    """Drop this process's encoders, which their caches hold in a circle. A function of the module: a task's own function
    would name a copy of the driver's table, and bring its encoders along."""
    _ENCODERS.clear()
    gc.collect()
    tidy()


_TOKENS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("at", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _tokenizer(path: str, end_id: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, so_far = encoder(path), {}
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            sources = b.column("source").to_pylist()
            texts = [t or "" for t in b.column("text").to_pylist()]
            for a in range(0, len(texts), 256):
                ids = [x + end for x in enc.encode(texts[a : a + 256])]
                n, at = [len(x) // enc.dtype.itemsize for x in ids], []
                for s, k in zip(sources[a : a + 256], n, strict=True):
                    at.append(so_far.get(s, 0))
                    so_far[s] = at[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, 256), b.column("source").slice(a, 256), b.column("part").slice(a, 256), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=_TOKENS.names,
                )

    return run


def tokenize(docs: DataFrame, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, part, at, n, ids): at counts the tokens of the same source before it in its partition."""
    cols = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    return cols.mapInArrow(_tokenizer(path, end_id), _TOKENS)


class Mixture:
    """The schedule of a deficit round-robin over queues with these totals and whole weights."""

    def __init__(self, totals: list[int], weights: list[int], size: int):
        self.totals, self.weights, self.size = np.array(totals, np.int64), np.array(weights, np.int64), size
        self.all = int(self.totals.sum())
        self.windows = -(-self.all // size)

    def _sent(self, t: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent before tick t (rows: ticks; columns: queues)."""
        return np.minimum(self.totals, (2 * self.weights * t[:, None] + SCALE - 1) // (2 * SCALE))

    def sent(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent when these windows (in rising order) begin."""
        goal = np.minimum(np.asarray(windows, np.int64) * self.size, self.all)
        last = int(((2 * self.totals + 1) * SCALE // (2 * self.weights)).max(initial=0)) + 2
        ends = goal[[0, -1]]
        for goals in (ends, goal):  # between the outer windows' ticks lie the others'
            if goals is ends:
                low, high = np.zeros(2, np.int64), np.full(2, last, np.int64)
            else:
                low, high = np.full(len(goal), low[0], np.int64), np.full(len(goal), low[1] + 1, np.int64)
            while (high - low > 1).any():  # the latest tick by which no more than the goal is sent
                mid = (low + high) // 2
                fits = self._sent(mid).sum(axis=1) <= goals
                low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        base = self._sent(low)
        room = self._sent(low + 1) - base  # tokens of one tick go in the queues' order
        before = np.cumsum(room, axis=1) - room
        return base + np.clip((goal - base.sum(axis=1))[:, None] - before, 0, room)

    def window_of(self, queue: int, token: int) -> int:
        """The window that holds this token of the queue."""
        tick = (2 * token + 1) * SCALE // (2 * int(self.weights[queue]))
        base, after = self._sent(np.array([tick, tick + 1]))
        place = int(base.sum()) + int((after - base)[:queue].sum()) + token - int(base[queue])
        return place // self.size


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def _cutter(mixture: Mixture, order: dict, width: int, with_ids: bool):
    n_queues = len(mixture.totals)
    step = max(1, (1 << 19) // n_queues) if n_queues else 1  # windows solved at a time, in bounded memory

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        """All pieces of the batch: its documents cut at the edges of the windows."""
        sources = batch.column("source").to_pylist()
        begin = np.asarray(batch.column("base")) + np.asarray(batch.column("at"))
        end, found = begin + np.asarray(batch.column("n")), []
        rows_of: dict = {}
        for i, x in enumerate(sources):
            rows_of.setdefault(order.get(x, len(order)), []).append(i)  # the shared queue is the last
        for q, rows in rows_of.items():
            rows = np.array(rows)
            first, last = mixture.window_of(q, int(begin[rows].min())), mixture.window_of(q, int(end[rows].max()) - 1)
            for a in range(first, last + 1, step):
                span = np.arange(a, min(last + 1, a + step) + 1)
                sent = mixture.sent(span)
                edges, at = sent[:, q], (sent[1:] - sent[:-1])[:, :q].sum(axis=1)
                lo, hi = np.maximum(begin[rows], edges[0]), np.minimum(end[rows], edges[-1])
                on = np.flatnonzero(lo < hi)
                k0, k1 = np.searchsorted(edges, lo[on], side="right") - 1, np.searchsorted(edges, hi[on], side="left")
                row = np.repeat(on, k1 - k0)
                k = np.arange(len(row)) - np.repeat(np.cumsum(k1 - k0) - (k1 - k0), k1 - k0) + np.repeat(k0, k1 - k0)
                x, y = np.maximum(lo[row], edges[k]), np.minimum(hi[row], edges[k + 1])
                some = np.flatnonzero(x < y)
                row, k, x, y = row[some], k[some], x[some], y[some]
                found.append(np.stack([rows[row], x - begin[rows[row]], y - x, span[k], at[k] + x - edges[k]]))
        row, start, length, window, offset = np.concatenate(found, axis=1)
        by_row = np.lexsort((start, row))
        row, start, length, window, offset = (v[by_row] for v in (row, start, length, window, offset))
        ids, pieces, sums, was = batch.column("ids"), [], [], -1
        for i, a, b in zip(row.tolist(), start.tolist(), (start + length).tolist(), strict=True):
            if i != was:
                raw, was = memoryview(ids[i].as_buffer()), i
                wide = memoryview(np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes())
            sums.append(zlib.crc32(wide[4 * a : 4 * b]))
            if with_ids:
                pieces.append(bytes(raw[width * a : width * b]))
        pieces = pa.array(pieces, pa.binary()) if with_ids else pa.nulls(len(row), pa.binary())
        pick = pa.array(row)
        columns = [batch.column("doc_id").take(pick), batch.column("source").take(pick), start, length, batch.column("n").take(pick), window, offset, pieces, pa.array(sums, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=_PIECES.names)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()  # a reused worker's, of the tokenising stage
        for b in batches:
            for a in range(0, b.num_rows, 512):
                yield cut(b.slice(a, 512))

    return run


def pack(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    size: int = WINDOW,
    weights: Mapping[str | None, float] | None = None,
    max_sources: int = 10_000,
    with_ids: bool = True,
    **columns: str,
) -> DataFrame:
    """Rows for each piece of a document: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32.

    weights: target proportions of the sources in every window; without them the corpus's own, so
    that all queues end together. Sources without a weight get the least one. ids: little-endian,
    as wide as the tokenizer needs (null without with_ids). ids_crc32: of 32-bit ids. Of more than
    max_sources sources those with a weight, then the largest, have queues of their own; the rest share one, by
    input partition and source, with their sources' weights together.
    """
    work = Workspace(spark, "pack")
    tokens = work.write(tokenize(docs, path, end_id, **columns), "tokens")
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = work.write(sums, "sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    totals = by_source.limit(max_sources + 1).collect()
    weigh = lambda rows: [float(r["n"] if weights is None else weights.get(r["source"], 0)) for r in rows]
    folded, rest, rest_share = len(totals) > max_sources, 0, 0.0
    sums = sums.select("part", F.col("source").alias("_source"), "n")
    queue = ["_source"]
    if folded:
        named = F.col("source").isin([x for x in weights or () if x is not None]) | F.lit(None in (weights or ())) & F.col("source").isNull()
        named = F.coalesce(named, F.lit(False))
        totals = by_source.orderBy(named.desc(), F.desc("n"), "source").limit(max_sources - 1).collect()
        own = spark.createDataFrame([(r["source"],) for r in totals], "_own string").withColumn("_has", F.lit(True))
        others = by_source.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("_own")), "left_anti")
        rest = others.agg(F.sum("n")).first()[0]
        rest_share = float(rest) if weights is None else sum(weigh(others.where(named).collect()))
        sums = sums.join(F.broadcast(own), F.col("_source").eqNullSafe(F.col("_own")), "left")
        queue = ["_has", "_own"]
    totals.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    share, sizes = weigh(totals) + [rest_share] * folded, [r["n"] for r in totals] + [rest] * folded
    top = max(share, default=1) or 1
    mixture = Mixture(sizes, [max(1, round(x / top * SCALE)) for x in share], size)
    order = {r["source"]: i for i, r in enumerate(totals)}
    before = F.expr(f"sum(n) over (partition by {', '.join(queue)} order by part, _source rows between unbounded preceding and 1 preceding)")
    bases = work.write(sums.select(F.col("part").alias("_part"), "_source", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    placed = tokens.join(bases, (tokens["part"] == bases["_part"]) & tokens["source"].eqNullSafe(bases["_source"]))
    width = encoder(path).dtype.itemsize
    placed = placed.select("doc_id", "source", "base", "at", "n", "ids")
    return placed.mapInArrow(_cutter(mixture, order, width, with_ids), _PIECES)
