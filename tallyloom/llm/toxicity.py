"""Toxicity: a logistic classifier that is held to equal scores when identity terms are swapped.

Features are hashed words and word beginnings (4 to 6 bytes, which carry coined and inflected forms),
present or not. ``fit`` takes a bounded sample of labelled rows (``SAMPLE``, the least by a hash of
their id), keeps the ``FEATURES`` features with the clearest evidence, counted in Spark, and minimises, in
numpy on the driver, which gets no more than a bit for each row and kept feature (2 MB),

    log loss + L2 |w|^2 + FAIR * mean over swapped pairs (w.x - w.x')^2

where x' are the features of a labelled text with each identity term replaced by the next term of its
group. Neutral sentences about each term join the sample as not toxic, so that a mention alone says
nothing. ``score`` sees a text only; ids, labels, languages and sources are no inputs.

Edge cases: null and empty texts score as a text without features does; texts are read whole, in
blocks; repeated rows each get their score, rows with a null id too (they count as held out and are never
learned from); of labels that repeat an id the highest counts, of texts that repeat one the least; features
that tie in evidence go by number; an empty table of labels gives the prior one half less a little, an
empty table no rows; input columns with the result's names (in any case, as Spark compares them) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._shared import Workspace, tidied
from tallyloom.llm._text import SPACE, Words, chunks, mix

#: Labelled rows to fit on, at most; features kept; weight of the swapped pairs and of |w|^2.
SAMPLE, FEATURES, FAIR, L2 = 12_000, 1_500, 2.0, 2e-4
BITS = 20
# Groups of identity terms, swapped within their group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("blind", "deaf", "disabled"),
)
NEUTRAL = ("my neighbour is {}", "i am {} and so is my family", "many {} people live here", "she wrote about being {}", "the {} community met today")
_NEXT = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}
_TERMS = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.ASCII | re.IGNORECASE)
_APART = SPACE.copy()
_APART[[ord(c) for c in "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~"]] = True


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next of its group; None without any."""
    out, n = _TERMS.subn(lambda m: _NEXT[m.group().lower()], text)
    return out if n else None


def _lower(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, feature of each word, text of each word) for blocks of texts; features are below 2**BITS."""
    for a, b in chunks(texts):
        w = Words(texts[a:b], lower=False, apart=_APART)
        doc = np.repeat(np.arange(b - a), np.diff(w.first))
        cols, docs = [mix(w.hashes) >> np.uint64(64 - BITS)], [doc]
        for k in (4, 5, 6):
            p = w.prefixes(k)
            on = np.flatnonzero(p)
            cols.append(p[on] >> np.uint64(64 - BITS))
            docs.append(doc[on])
        yield a, np.concatenate(cols).astype(np.int64), np.concatenate(docs)


def _bags(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct features."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    for first, cols, docs in features(texts):
        pairs = np.unique(docs << BITS | cols)
        d = pairs >> BITS
        edges = np.flatnonzero(np.diff(d, prepend=-1))
        for x in np.split(pairs, edges[1:]) if len(pairs) else []:
            out[first + int(x[0] >> BITS)] = x & ((1 << BITS) - 1)
    return out


@tidied
def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = part.column("text").to_pylist()
            other = [swapped(t) if t else None for t in texts]
            bags = [x.astype("<i4").tobytes() for x in _bags([_lower(t) for t in texts])]
            pairs = [x.astype("<i4").tobytes() for x in _bags([_lower(t) for t in other])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(bags, pa.binary()), pa.array([p if o else None for p, o in zip(pairs, other, strict=True)], pa.binary())], names=["doc_id", "label", "bag", "swapped"])


class Model:
    """weights by feature; slot: each feature's place among the kept ones, or -1."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.kept, self.weights, self.bias = kept, weights, bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.kept] = np.arange(len(self.kept))
        z = np.full(len(texts), self.bias)
        for first, cols, docs in features(texts):
            s = slot[cols]
            on = np.flatnonzero(s >= 0)
            pairs = np.unique(docs[on] * np.int64(len(self.kept) + 1) + s[on])
            d, f = np.divmod(pairs, len(self.kept) + 1)
            np.add.at(z, first + d, self.weights[f])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pull(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient of the penalty on score changes; in the precision of the rows, so that they aren't copied."""
    return 2 * FAIR * (diff.T @ (diff @ w.astype(diff.dtype))).astype(float) / len(diff) if len(diff) else np.zeros(len(w))


def _minimise(x: np.ndarray, y: np.ndarray, diff: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the regularised loss."""
    n, k = x.shape
    w, v, bias, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    weight = np.where(y > 0, n / (2 * max(1, y.sum())), n / (2 * max(1, (1 - y).sum()))) ** 0.5
    weight /= weight.mean()
    u, ub, smooth = np.ones(k), 1.0, 1.0
    for _ in range(30):  # the loss curves no more than this, by power iteration
        h = x @ u.astype(x.dtype) + ub
        u, ub = 0.25 * x.T @ (weight * h).astype(x.dtype) / n + 2 * L2 * u + _pull(diff, u), 0.25 * (weight * h).sum() / n
        smooth = np.sqrt(u @ u + ub * ub)
        u, ub = u / smooth, ub / smooth
    smooth *= 1.1
    for r in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(x.dtype) + vb, -40, 40)))
        e = weight * (p - y) / n
        g = x.T @ e.astype(x.dtype) + 2 * L2 * v + _pull(diff, v)
        w2, b2 = v - g / smooth, vb - e.sum() / smooth
        m = r / (r + 3)
        v, vb = w2 + m * (w2 - w), b2 + m * (b2 - bias)
        w, bias = w2, b2
    return w, bias


def evidence(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """How many of its standard errors a feature's log odds ratio is from none, from the rows that have it."""
    a, b, c, d = (x + F.lit(0.5) for x in (pos, neg, F.lit(n_pos) - pos, F.lit(n_neg) - neg))
    return F.abs(F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


@tidied
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, pos, neg): rows of this batch that have the feature."""
    for b in batches:
        labels = np.asarray(b.column("label")) > 0
        counts = []
        for which in (labels, ~labels):
            some = [np.frombuffer(x, "<i4") for x, on in zip(b.column("bag").to_pylist(), which, strict=True) if on]
            counts.append(np.bincount(np.concatenate([np.empty(0, np.int32), *some]), minlength=1 << BITS))
        on = np.flatnonzero(counts[0] + counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(counts[0][on]), pa.array(counts[1][on])], names=["feature", "pos", "neg"])


def _picked(kept: np.ndarray):
    """Each row's kept features, and those of its swapped form, as bits."""
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))

    def bits(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        has, s = np.zeros(len(kept), bool), slot[np.frombuffer(raw, "<i4")]
        has[s[s >= 0]] = True
        return np.packbits(has).tobytes()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array([bits(x) for x in b.column(n).to_pylist()], pa.binary()) for n in ("bag", "swapped")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *columns], names=["doc_id", "label", "bag", "swapped"])

    return run


def _neutral(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sentences that name a group and say nothing of it, and those less their swapped form."""
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))

    def dense(texts):
        out = np.zeros((len(texts), len(kept)), np.float32)
        for i, bag in enumerate(_bags([_lower(t) for t in texts])):
            s = slot[bag]
            out[i, s[s >= 0]] = 1
        return out

    terms = [NEUTRAL[i % len(NEUTRAL)].format(t) for i, t in enumerate(_NEXT)]
    rows = dense(terms)
    return rows, rows - dense([swapped(t) for t in terms])


def fit_rows(kept: np.ndarray, x: np.ndarray, y: np.ndarray, swaps: np.ndarray) -> Model:
    """The model of rows x (of 0 and 1, a column for each kept feature) with labels y; swaps: rows of x less their swapped form."""
    neutral, diff = _neutral(kept)
    return Model(kept, *_minimise(np.concatenate([x, neutral]), np.concatenate([y, np.zeros(len(neutral))]), np.concatenate([swaps, diff])))


def _unpacked(rows: list[bytes], out: np.ndarray) -> None:
    """Rows of bits as the first rows of an array, a few at a time."""
    for a in range(0, len(rows), 512):
        some = rows[a : a + 512]
        if out.shape[1]:
            out[a : a + len(some)] = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), axis=1, count=out.shape[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """docs: doc_id and text; labels: doc_id and label (0, 1; null: left out). Ids may repeat."""
    work = Workspace(docs.sparkSession, "toxicity")
    rows = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")  # rows: at most ``sample``
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    bags = work.write(texts.mapInArrow(_bag_rows, "doc_id long, label int, bag binary, swapped binary"), "bags")
    n_pos, n_neg = (max(1, x or 0) for x in bags.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first())
    counts = bags.mapInArrow(_counted, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    z = evidence(F.col("pos"), F.col("neg"), n_pos, n_neg)
    kept = np.sort(np.array([r[0] for r in counts.where(z > 3).orderBy(z.desc(), "feature").limit(FEATURES).select("feature").collect()], np.int64))
    got = bags.mapInArrow(_picked(kept), bags.schema).toArrow()
    work.drop("bags")
    order = np.argsort(np.asarray(got.column("doc_id")), kind="stable")
    bag, other = got.column("bag").to_pylist(), got.column("swapped").to_pylist()
    on = [k for k, i in enumerate(order) if other[i] is not None]
    neutral, turned = _neutral(kept)
    # both arrays are made once, at their full size
    x, diff = np.empty((len(order) + len(neutral), len(kept)), np.float32), np.empty((len(on) + len(neutral), len(kept)), np.float32)
    _unpacked([bag[i] for i in order], x)
    _unpacked([other[order[k]] for k in on], diff)
    x[len(order) :], diff[len(on) :] = neutral, turned
    for a in range(0, len(on), 512):
        np.subtract(x[on[a : a + 512]], diff[a : min(a + 512, len(on))], out=diff[a : min(a + 512, len(on))])
    y = (np.asarray(got.column("label"))[order] > 0).astype(float)
    return Model(kept, *_minimise(x, np.concatenate([y, np.zeros(len(neutral))]), diff))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from one half on)."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                s = model.score([_lower(t) for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=kept + ["score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text leaves 0 by 5, and for ids that are null: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
