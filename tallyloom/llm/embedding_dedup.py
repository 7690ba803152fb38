"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

Each vector is normalised and turned by several random rotations (QR factors, fixed seeds); the signs
of a turned vector are its code, and with x the vector and s the signs over sqrt(d), turned back,
f = <s, x> is the code's correction factor. Codes and factors are stored, an eighth of a byte and 2
bytes a rotation and dimension. s / f is x plus a random error at right angles to x; so with the
even rotations' mean for x and the odd ones' for y, whose errors are independent,
<s_x / f_x, s_y / f_y> is an unbiased estimate of <x, y>. With g = (1 - f^2) / f^2 over the number of
rotations, its variance where <x, y> = t is ((g_x + g_y)(1 - t^2) + g_x g_y) / (d - 1), and it is
nearly Gaussian: pairs estimated more than ``SIGMAS`` of that below the threshold t are rejected from
the codes alone, the others are recomputed exactly, in double precision.

Candidates: the bits of the codes are cut into bands; vectors of one label that agree in a band meet
in that band's bucket. The bits of a band follow from the number of vectors (buckets stay near
``BUCKET`` for unrelated vectors), the number of bands from the wanted recall at the threshold:
agreement in a bit has probability 1 - acos(t) / pi. Buckets get codes, never vectors. A pair counts
only in the first band in which it agrees. Buckets of more than ``BLOCK`` vectors are split into
blocks, and every pair of blocks is a task's group of its own. A first pass names the vectors of each
group that have an undecided pair there; only these vectors are fetched, once for each such group, and
a second pass recomputes the undecided pairs. No pair is emitted or shuffled: a group gives link
counts and a spanning forest of its links. Equal vectors of a label are one class with a size, so hot
copies cost one row.

Edge cases: vectors that are null, zero, hold null or non-finite components, and those with a null
label, link with nothing; vectors of different lengths are never linked; repeated ids count as
vectors of their own; a null id takes part, names no component and is never kept; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._shared import Workspace
from tallyloom.llm.components import components

THRESHOLD, BUCKET, BLOCK, RECALL, SIGMAS, SEED = 0.93, 2048, 1024, 0.985, 4.0, 11
#: Below so many dimensions errors are far from Gaussian and every pair is recomputed.
FEW = 16
#: Rows of (bucket, blocks) and of class ids that are broadcast, 16 bytes each; beyond, both sides are shuffled.
BROADCAST_ROWS = 1 << 20


@functools.lru_cache(64)
def rotation(d: int, r: int) -> np.ndarray:
    """The r-th random rotation of d dimensions; the same everywhere."""
    q, t = np.linalg.qr(np.random.default_rng((SEED, d, r)).standard_normal((d, d)))
    return q * np.sign(np.diag(t))


def band_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, bands) for n vectors."""
    bits = max(5, math.ceil(math.log2(max(2, n / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def rotations(d: int, bits: int, bands: int) -> int:
    """Rotations whose signs make the bands; one for each side of an estimate at least."""
    return max(2, -(-bits * bands // d))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs [n, r * d], factors [n, r] in 65535ths) of unit vectors."""
    turned = [x @ rotation(x.shape[1], i) for i in range(r)]
    factors = np.stack([np.abs(t).sum(axis=1) / math.sqrt(x.shape[1]) for t in turned], axis=1)
    return np.concatenate([t > 0 for t in turned], axis=1), np.clip(np.rint(factors * 65535), 1, 65535).astype("<u2")


def band_values(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """[n, bands] values of the bands, from the first signs."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([signs[:, b * bits : (b + 1) * bits] @ weights for b in range(bands)], axis=1)


class Codes:
    """Stored codes of some vectors of d dimensions: their signs and the two sides of an estimate."""

    def __init__(self, packed: list[bytes], d: int, bits: int, bands: int):
        self.d, r = d, rotations(d, bits, bands)
        raw = np.stack([np.frombuffer(v, np.uint8) for v in packed])
        f = np.ascontiguousarray(raw[:, : 2 * r]).view("<u2").astype(np.float64) / 65535
        self.signs = np.unpackbits(raw[:, 2 * r :], axis=1, count=r * d).astype(bool)
        self.bands = band_values(self.signs, bits, bands)
        noise = np.maximum(0, 1 - f * f) / (f * f)
        self.side, self.noise = [], []
        for k in (0, 1):
            own = range(k, r, 2)
            turned = [np.where(self.signs[:, i * d : (i + 1) * d], 1.0, -1.0) @ (rotation(d, i).T / math.sqrt(d)) / f[:, i : i + 1] for i in own]
            self.side.append((sum(turned) / len(own)).astype(np.float32))
            self.noise.append(noise[:, k::2].sum(axis=1) / len(own) ** 2)

    def undecided(self, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of left, of right) whose upper bound reaches the threshold."""
        if self.d < FEW:
            i, j = np.divmod(np.arange(len(left) * len(right)), max(1, len(right)))
            return left[i], right[j]
        estimate = self.side[0][left] @ self.side[1][right].T
        gx, gy = self.noise[0][left][:, None], self.noise[1][right][None]
        slack = SIGMAS * np.sqrt(((gx + gy) * (1 - threshold**2) + gx * gy) / (self.d - 1))
        i, j = np.nonzero(estimate >= threshold - slack)
        return left[i], right[j]


def pack(signs: np.ndarray, factors: np.ndarray) -> list[bytes]:
    """Factors, then signs, for each row."""
    return [a.tobytes() + b.tobytes() for a, b in zip(factors, np.packbits(signs, axis=1), strict=True)]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that join what the pairs join, at most n - 1."""
    parent, out = list(range(n)), []

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def _coded(bits: int, bands: int, kind: str):
    """(vec_id, label, d, vector, key, code, bands): nulls where the vector can't link. vector: packed as given, in floats or doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                labels, n = b.column("label").to_pylist(), b.num_rows
                d, vector, key, code, values = ([None] * n for _ in range(5))
                rows_of: dict[int, list[int]] = {}
                for i, (v, label) in enumerate(zip(b.column("embedding").to_pylist(), labels, strict=True)):
                    if v and label is not None and all(c is not None for c in v):
                        a = np.array(v, np.float64)
                        if np.isfinite(a).all() and a.any():
                            d[i], vector[i] = len(a), (a + 0.0).astype(kind)
                            rows_of.setdefault(len(a), []).append(i)
                            key[i] = hashlib.md5(f"{len(a)}:{label}:".encode() + vector[i].tobytes()).digest()
                for dims, rows in rows_of.items():
                    signs, factors = encode(unit(np.stack([vector[i] for i in rows])), rotations(dims, bits, bands))
                    for i, c, x in zip(rows, pack(signs, factors), band_values(signs, bits, bands).tolist(), strict=True):
                        code[i], values[i] = c, x
                vector = [None if v is None else v.tobytes() for v in vector]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("label"), pa.array(d, pa.int64()), pa.array(vector, pa.binary()), pa.array(key, pa.binary()), pa.array(code, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
                    names=["vec_id", "label", "d", "vector", "key", "code", "bands"],
                )

    return run


def _group(table: pa.Table, bits: int, bands: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one pair of blocks: rows (i, j) of the undecided pairs that agree in this band first, and all rows of their label and length.

    Buckets are named by a hash, so those of other labels may fall in: they are told apart here.
    """
    ids, block, band = np.asarray(table.column("class_id")), np.asarray(table.column("block")), np.asarray(table.column("band"))
    lo, hi = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    packed = table.column("code").to_pylist()
    kinds: dict = {}
    for i, kind in enumerate(zip(table.column("label").to_pylist(), table.column("d").to_pylist(), band.tolist(), strict=True)):
        kinds.setdefault(kind, []).append(i)
    for (_, d, own), rows in kinds.items():
        rows = np.array(rows)
        codes = Codes([packed[i] for i in rows], d, bits, bands)
        left, right = np.flatnonzero(block[rows] == lo), np.flatnonzero(block[rows] == hi)
        for k in range(0, len(left), 512):
            i, j = codes.undecided(left[k : k + 512], right, threshold)
            if lo == hi:
                once = ids[rows[i]] < ids[rows[j]]
                i, j = i[once], j[once]
            for c in range(0, len(i), 1 << 16):
                x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                same = codes.bands[x] == codes.bands[y]
                first = same[:, own] & ~same[:, :own].any(axis=1)
                yield rows[x[first]], rows[y[first]], rows


def _undecided(bits: int, bands: int, threshold: float):
    """The vectors of one pair of blocks that have an undecided pair there."""

    def run(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for i, j, _ in _group(table, bits, bands, threshold):
            some[i] = some[j] = True
        return table.select(["bucket", "a", "b", "band", "block", "class_id"]).filter(pa.array(some))

    return run


def _links(bits: int, bands: int, kind: str, threshold: float):
    """Of one pair of blocks, with the vectors: link counts and a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes = np.asarray(table.column("class_id")), np.asarray(table.column("size"))
        vectors = table.column("vector").to_pylist()
        count, tree, x, was = np.zeros(len(ids)), [], None, None
        for i, j, rows in _group(table, bits, bands, threshold):
            if rows is not was:
                x, was, at = unit(np.stack([np.frombuffer(vectors[k], kind) for k in rows])), rows, np.empty(len(ids), np.int64)
                at[rows] = np.arange(len(rows))
            ok = np.einsum("ij,ij->i", x[at[i]], x[at[j]]) >= threshold
            i, j = i[ok], j[ok]
            count += np.bincount(i, sizes[j], len(ids)) + np.bincount(j, sizes[i], len(ids))
            if len(i):
                before = np.array(tree, np.int64).reshape(-1, 2)
                tree = _forest(np.concatenate([before[:, 0], i]), np.concatenate([before[:, 1], j]), len(ids))
        on = np.flatnonzero(count)
        src = np.concatenate([ids[on], ids[[a for a, _ in tree]]]) if tree else ids[on]
        dst = [None] * len(on) + (ids[[b for _, b in tree]].tolist() if tree else [])
        n = count[on].astype(np.int64).tolist() + [0] * len(tree)
        return pa.table({"x": pa.array(src, pa.int64()), "y": pa.array(dst, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    work = Workspace(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    bits, bands = band_plan(rows.count(), threshold, recall)
    kind = "<f4" if rows.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    coded = rows.mapInArrow(_coded(bits, bands, kind), "vec_id long, label string, d long, vector binary, key binary, code binary, bands array<bigint>")
    coded = work.write(coded.withColumn("row_id", F.monotonically_increasing_id()), "coded")
    # equal vectors of a label: one class, named by one of its rows
    own = F.struct("label", "d", "code", "bands")
    classes = coded.where("key is not null").groupBy("key").agg(F.min("row_id").alias("class_id"), F.min("vec_id").alias("least"), F.count("*").alias("size"), F.min_by(own, "row_id").alias("own"))
    classes = work.write(classes.select("key", "class_id", "least", "size", "own.*"), "classes")
    # buckets of several classes, in blocks, every two blocks a group
    entries = classes.select("class_id", "label", "d", "code", F.posexplode("bands").alias("band", "value"))
    entries = entries.select(F.xxhash64("label", "d", "band", "value").alias("bucket"), "band", "class_id", "label", "d", "code")
    full = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    full = work.write(full.select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "full")
    members = entries.join(F.broadcast(full) if full.count() <= BROADCAST_ROWS else full, "bucket")
    members = members.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    grouped = members.select("bucket", "band", "class_id", "label", "d", "code", "block", other)
    grouped = grouped.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "band", "class_id", "label", "d", "code", "block")
    names = "bucket long, a int, b int, band int, block int, class_id long"
    undecided = work.write(grouped.groupBy("bucket", "a", "b").applyInArrow(_undecided(bits, bands, threshold), names), "undecided")
    # the vectors of undecided pairs, and their exact products
    wanted = work.write(undecided.select("class_id").distinct(), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    fetched = coded.select(F.col("row_id").alias("class_id"), "vector", "label", "d", "code").join(wanted, "class_id")
    fetched = fetched.join(classes.select("class_id", "size"), "class_id")
    made = undecided.join(fetched, "class_id").groupBy("bucket", "a", "b").applyInArrow(_links(bits, bands, kind, threshold), "x long, y long, n long")
    made = work.write(made, "links")
    counts = made.where("y is null").groupBy("x").agg(F.sum("n").alias("links")).withColumnRenamed("x", "class_id")
    labels = components(work, made.where("y is not null").select(F.col("x").alias("a"), F.col("y").alias("b")), "components")
    named = classes.select("key", "class_id", "size", "least").join(counts, "class_id", "left")
    named = named.join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    named = work.write(named, "named")
    work.keep("coded", "named")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(first, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), "component_id")
    out = coded.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
