"""Self-join of texts on the Jaccard similarity of their word n-grams: a size-aware heavy-light join.

A text's set is its distinct n-grams of lower-cased words, as 64-bit hashes (a text of fewer words is
one gram, a text without words has none). Texts of equal sets are one class; the join runs on classes,
which have names of 64 bits (of ten billion different sets some three pairs can be expected to share one).

* Light sets (up to a boundary) enumerate fixed-size subsets: for every pair of sizes (n, m) that can
  link, all subsets of the least overlap such sets must have. Two sets that meet in a subset link:
  nothing is left to verify.
* Heavy sets scan inverted lists: each set enters the lists of its prefix, the first n - ceil(0.8 n) + k
  grams in one global order, of which any linked set must share k (k = 1 + n // 20). In that order frequent grams come last
  (counts over all texts; the most frequent ``HOT`` grams, 12 MB, are broadcast and the rest follow a
  hash), so a passage that many texts share stays out of the lists.
* The boundary is the largest size whose subsets cost no more than its lists: subsets of a set against
  prefix grams times (1 + mean list length), the latter measured over all texts.

Lists are not expanded into pairs. The members of a list are first compared with one of them, whole
sets, exactly; linked ones join components, and only members of one list that are still in different
components are compared, first again by one leader, last with each other. In that last round a pair
is made only in the shortest list that it shares, and there only if both sets are in as many longer
lists as a link of their sizes still asks for; so what a long list makes is few pairs, not its square.
Thus every pair that shares enough lists is verified or already connected, no link between components
is lost, and a group of m copies costs about m comparisons.

Edge cases: null and empty texts, and those of white space, have no grams and link with nothing;
repeated rows link like other copies; a null doc_id takes part and names no component; texts are read
whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm._blobs import buckets, get, put, runs
from tallyloom.llm._shared import Workspace, tidied, tidied_group
from tallyloom.llm._text import Words, chunks, mix, ngram_hashes, odd_constants, utf8
from tallyloom.llm.components import components

GRAM, HOT, FREQUENT, FLUSH, BUCKET_BYTES, BROADCAST, LEADERS = 5, 1 << 20, 16, 500_000, 3_000_000, 32 << 20, 2
#: One of so many grams is added to prefixes, to ask for more than one shared list.
SHARE = 20
#: Similarity 0.8 as a fraction; sizes that light sets may have at most.
NUM, DEN, LIGHT_MOST = 4, 5, 14
#: Grams are counted without these low bits: two that fall together only share a place in the order.
COARSE = np.uint64(16)
#: Batches in which a flush is handed on.
SLICES = 8
#: What an entry of a list is (near): of the prefix's tail; of the part that the smaller set of a pair
#: must share; a subset for two sizes; a subset for sets of one size.
TAIL, NEAR, ODD, EVEN = 0, 1, 2, 3


def sets_of(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text, sorted distinct gram hashes) of every text."""
    for a, b in chunks(texts):
        w = Words(texts[a:b], lower=True)
        grams = ngram_hashes(w.hashes, k)
        for i, (x, y) in enumerate(itertools.pairwise(w.first.tolist())):
            if y - x >= k:
                yield a + i, np.unique(grams[x : y - k + 1])
            elif y > x:
                short = mix((w.hashes[x:y] * odd_constants(y - x, 1000 + y - x)).sum(keepdims=True, dtype=np.uint64))
                yield a + i, short
            else:
                yield a + i, np.empty(0, np.uint64)


def class_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(mix(grams).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(grams))).view(np.int64)[0])


def least_overlap(n: int, m: int) -> int:
    """Grams that sets of these sizes share at least when they link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def partners(n: int) -> list[tuple[int, int]]:
    """Pairs of sizes (smaller, larger), one of them n, that can link."""
    low, high = -(-NUM * n // DEN), DEN * n // NUM
    return [(min(n, m), max(n, m)) for m in range(max(1, low), high + 1) if least_overlap(n, m) <= min(n, m)]


def subset_count(n: int) -> int:
    return sum(comb(n, least_overlap(a, b)) for a, b in partners(n))


def shared_least(n: int) -> int:
    """Lists that a linked pair shares at least, n being the smaller size: the prefixes are longer by that less one."""
    return 1 + n // SHARE


def prefix(n: int) -> int:
    return min(n, n - -(-NUM * n // DEN) + shared_least(n))


def index_prefix(n: int) -> int:
    """The part of the prefix in which the smaller set of a pair shares that many."""
    return min(n, n - least_overlap(n, n) + shared_least(n))


def boundary(mean_list: float) -> int:
    """The largest size for which subsets are cheaper than lists."""
    n = 0
    while n < LIGHT_MOST and subset_count(n + 1) <= prefix(n + 1) * (1 + mean_list) * 8:
        n += 1
    return n


def subset_keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each pair of sizes and each subset of the overlap that it asks for; EVEN where the sizes are equal, else ODD."""
    n, keys, near = len(grams), [], []
    for a, b in partners(n):
        c = least_overlap(a, b)
        pick = np.array(list(itertools.combinations(range(n), c)))
        keys.append(mix(mix(grams)[pick].sum(axis=1, dtype=np.uint64) + np.uint64(a * 1_000_003 + b * 101 + c)))
        near.append(np.full(len(pick), EVEN if a == b else ODD))
    return np.concatenate(keys), np.concatenate(near)


def _named(k: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            n, name = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, s in sets_of(texts, k):
                n[i], name[i] = len(s), class_of(s) if len(s) else 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n), pa.array(name)], names=["doc_id", "text_key", "n", "set_id"])

    return run


def _distinct_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(name, grams) of the distinct sets of a task, many grams at a time."""
    held, size = {}, 0
    for b in batches:
        for _, s in sets_of(utf8(b.column("text")), k):
            if len(s):
                name = class_of(s)
                if name not in held:
                    held[name] = s
                    size += len(s)
            if size >= FLUSH:
                yield list(held.items())
                held, size = {}, 0
    if held:
        yield list(held.items())


def _bucket(keys: np.ndarray, n_buckets: int, bits: int = 64) -> np.ndarray:
    """Ranges of the keys, so that differences within a bucket are small."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _slices(some: list) -> Iterator[list]:
    size = -(-len(some) // SLICES)
    for a in range(0, len(some), size or 1):
        yield some[a : a + size]


def _sorted_put(keys: np.ndarray) -> bytes:
    return put(keys.view(np.int64))


def _counter(k: int, n_buckets: int):
    """(bucket, grams, counts) for the flushes of a task."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _distinct_sets(batches, k):
            grams, counts = np.unique(np.concatenate([s for _, s in sets]) >> COARSE, return_counts=True)
            bucket = _bucket(grams, n_buckets, 64 - int(COARSE))
            e = runs(bucket)
            for cut in _slices([slice(a, b) for a, b in itertools.pairwise(e.tolist())]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[o][0]) for o in cut], pa.int32()), pa.array([_sorted_put(grams[o]) for o in cut], pa.binary()), pa.array([put(counts[o], delta=False) for o in cut], pa.binary())],
                    names=["bucket", "grams", "counts"],
                )

    return run


@tidied_group
def _frequent(table: pa.Table) -> pa.Table:
    """Of one bucket: how many grams and occurrences, and the frequent grams with their counts by power of two."""
    grams = np.concatenate([get(x) for x in table.column("grams").to_pylist()])
    counts = np.concatenate([get(x, delta=False) for x in table.column("counts").to_pylist()])
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    r = runs(grams)
    total = np.add.reduceat(counts[order], r[:-1])
    distinct = grams[r[:-1]]
    out = [(-1, len(total), int(total.sum()), float((total.astype(float) ** 2)[total < FREQUENT].sum()), b"", b"")]
    power = np.floor(np.log2(total)).astype(np.int64)
    for p in np.unique(power[total >= FREQUENT]).tolist():
        on = (power == p) & (total >= FREQUENT)
        out.append((p, int(on.sum()), int(total[on].sum()), 0.0, distinct[on].astype("<i8").tobytes(), total[on].astype("<i8").tobytes()))
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("power", "n", "total", "squares", "grams", "counts"), zip(*out, strict=True), kinds, strict=True)})


_LISTED = "key long, set_id long, n int, near int"


def _lister(k: int, n_buckets: int, light: int, hot: np.ndarray, hot_counts: np.ndarray):
    """(bucket, keys, names, sizes, near) for the flushes of a task."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _distinct_sets(batches, k):
            keys, names, sizes, near = [], [], [], []
            every = np.concatenate([s for _, s in sets]) >> COARSE
            at = np.searchsorted(hot, every)
            at[at == len(hot)] = 0
            weight = np.where(hot[at] == every, hot_counts[at], 0) if len(hot) else np.zeros(len(every), np.int64)
            begin = 0
            for name, s in sets:
                n, w = len(s), weight[begin : begin + len(s)]
                begin += n
                if n <= light:
                    x, y = subset_keys(s)
                    keys.append(x)
                    near.append(y)
                    names.append(np.full(len(x), name))
                    sizes.append(np.full(len(x), n))
                if n > light or DEN * n >= NUM * (light + 1):
                    p = prefix(n)
                    cold = np.flatnonzero(w == 0)[:p]
                    x = s[cold] if len(cold) == p else s[np.argsort(w, kind="stable")[:p]]
                    keys.append(x)
                    near.append(np.where(np.arange(p) < index_prefix(n), NEAR, TAIL))
                    names.append(np.full(p, name))
                    sizes.append(np.full(p, n))
            keys, names, sizes, near = np.concatenate(keys), np.concatenate(names), np.concatenate(sizes), np.concatenate(near)
            bucket = _bucket(keys, n_buckets)
            order = np.argsort(keys, kind="stable")
            e = runs(bucket[order])
            for cut in _slices([order[a:b] for a, b in itertools.pairwise(e.tolist())]):
                rows = [(int(bucket[o[0]]), _sorted_put(keys[o]), names[o].astype("<i8").tobytes(), put(sizes[o], delta=False), near[o].astype(np.int8).tobytes()) for o in cut]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["bucket", "keys", "names", "sizes", "near"])

    return run


@tidied_group
def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: the entries of the lists that hold several sets."""
    cols = [table.column(n).to_pylist() for n in ("keys", "names", "sizes", "near")]
    key = np.concatenate([get(x) for x in cols[0]])
    name = np.concatenate([np.frombuffer(x, "<i8") for x in cols[1]])
    n = np.concatenate([get(x, delta=False) for x in cols[2]])
    near = np.concatenate([np.frombuffer(x, np.int8) for x in cols[3]]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order]
    twice = np.zeros(len(key), bool)
    equal = same[1:] == same[:-1]
    twice[1:] |= equal
    twice[:-1] |= equal
    o = order[twice]
    o = o[np.lexsort((near[o], name[o], key[o]))]
    once = np.ones(len(o), bool)
    once[1:] = (key[o[1:]] != key[o[:-1]]) | (name[o[1:]] != name[o[:-1]])  # a set that several tasks sent
    o = o[once]
    r = runs(key[o])
    o = o[np.repeat(np.diff(r) > 1, np.diff(r))]
    return pa.table({"key": pa.array(key[o]), "set_id": pa.array(name[o]), "n": pa.array(n[o].astype(np.int32)), "near": pa.array(near[o].astype(np.int32))})


def _sets(k: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("set_id").to_pylist()
            for a in range(0, b.num_rows, 200):
                found = sets_of(utf8(b.column("text").slice(a, 200)), k)
                out = [(names[a + i], s.tobytes()) for i, s in found if len(s) and class_of(s) == names[a + i]]  # ids may repeat
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["set_id", "grams"])

    return run


@tidied
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, linked) of pairs with their sets."""
    for b in batches:
        linked = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
            linked.append(DEN * both >= NUM * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _lists_needed(n: str = "n", m: str = "m") -> str:
    """SQL: the lists that a linked pair of sizes n <= m shares at least. Of two sets the one whose prefix ends first has
    all the grams that it shares up to there in both prefixes, and no more beyond than its rest is long."""
    overlap = f"({NUM} * ({n} + {m}) + {NUM + DEN - 1}) div {NUM + DEN}"
    rest = lambda x: f"greatest(0, ({NUM} * {x} + {DEN - 1}) div {DEN} - 1 - {{}} div {SHARE})".format(x)
    return f"greatest(1, {overlap} - greatest({rest(n)}, {rest(m)}))"


def _last_pairs(work: Workspace, entries: DataFrame, apart: Column, ends: tuple, sizes: tuple) -> DataFrame:
    """(a, b) of sets in different components that share as many lists as a link of their sizes must.

    entries: (key, set_id, n, component, length of the list). rest: the set's lists from this one on, by length. In the
    first list that a pair shares, neither rest can be less than the lists it must share in all.
    """
    by_length = Window.partitionBy("set_id").orderBy(F.desc("length"), F.desc("key"))
    entries = work.write(entries.select("key", "set_id", "n", "component", F.row_number().over(by_length).alias("rest")), "entries")
    needed = _lists_needed("least(o.n, l.n)", "greatest(o.n, l.n)")
    side = entries.select("key", F.struct("set_id", "n", "component", "rest").alias("o"))
    met = side.join(side.select("key", F.col("o").alias("l")), "key").where("o.set_id < l.set_id").where(apart)
    met = met.where(F.expr(f"least(o.rest, l.rest) >= {needed}")).select(*ends, *sizes).distinct()
    held = entries.groupBy("set_id").agg(F.collect_set("key").alias("keys"))
    met = met.join(held.select(F.col("set_id").alias("a"), F.col("keys").alias("x")), "a")
    met = met.join(held.select(F.col("set_id").alias("b"), F.col("keys").alias("y")), "b")
    return met.where(F.expr(f"size(array_intersect(x, y)) >= {_lists_needed()}")).select("a", "b")


def similar(spark: SparkSession, docs: DataFrame, k: int = GRAM) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) for each row of docs (doc_id, text)."""
    return linked(spark, docs, k).select("doc_id", "n_shingles", "component_id")


def linked(spark: SparkSession, docs: DataFrame, k: int = GRAM) -> DataFrame:
    """``similar`` with text_key (xxhash64 of the text) and first: of a row with links, whether its doc_id (null after
    all others) and text are the least of its component's; else null."""
    work = Workspace(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    named = work.write(keyed.mapInArrow(_named(k), "doc_id long, text_key long, n long, set_id long"), "named")
    texts = rows.select("text").where("text is not null")

    # how frequent grams are, and the order that puts frequent ones last
    n_buckets = buckets(rows, BUCKET_BYTES)
    counted = texts.mapInArrow(_counter(k, n_buckets), "bucket int, grams binary, counts binary")
    counted = counted.groupBy("bucket").applyInArrow(_frequent, "power int, n long, total long, squares double, grams binary, counts binary")
    counted = work.write(counted, "counted")
    sums = {r["power"]: r for r in counted.groupBy("power").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()}
    work.release()
    least, room = 64, HOT
    for p in sorted((p for p in sums if p >= 0), reverse=True):  # at most HOT grams reach the driver
        if sums[p]["n"] > room:
            break
        least, room = p, room - sums[p]["n"]
    got = counted.where(F.col("power") >= least).select("grams", "counts").collect()
    hot = np.concatenate([np.frombuffer(bytes(r["grams"]), "<i8") for r in got] or [np.zeros(0, "<i8")]).view(np.uint64)
    hot_counts = np.concatenate([np.frombuffer(bytes(r["counts"]), "<i8") for r in got] or [np.zeros(0, "<i8")])
    order = np.argsort(hot)
    hot, hot_counts = hot[order], hot_counts[order]
    every = sums.get(-1)
    light = boundary(every["squares"] / max(1, every["total"])) if every else 0

    # lists and subsets that several sets share
    listed = texts.mapInArrow(_lister(k, n_buckets, light, hot, hot_counts), "bucket int, keys binary, names binary, sizes binary, near binary")
    lists = work.write(listed.groupBy("bucket").applyInArrow(_shared, _LISTED), "lists")
    work.release()
    # sets that meet in a subset link, if the key is for their sizes: both of them, or equal ones
    subsets = lists.where(F.col("near") >= ODD)
    meet = subsets.groupBy("key").agg(F.min("set_id").alias("b"), F.countDistinct("n").alias("sizes")).where("sizes > 1")
    meet = meet.select("key", "b").unionByName(subsets.where(F.col("near") == EVEN).groupBy("key").agg(F.min("set_id").alias("b")))
    links = subsets.join(meet, "key").select(F.col("set_id").alias("a"), "b").where("a <> b").distinct()
    labels = work.write(components(work, links, "components_0"), "labels_0")

    # the sets of lists, the most shared first: copies with few changes of their own lead
    lists = lists.where(F.col("near") <= NEAR).select("key", "set_id", "n")
    lists = work.write(lists.join(lists.groupBy("set_id").agg(F.count("*").alias("shared")), "set_id"), "ranked")
    first_doc = F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id"))
    tried, member = None, F.struct("set_id", "n", "component", "shared")
    for step in range(LEADERS + 1):
        own = labels.select(F.col("node").alias("set_id"), "component")
        mine = lists.join(own, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        best = F.struct(F.xxhash64("set_id", F.lit(step)), "set_id") if step else F.struct("shared", "set_id")
        mixed = mine.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max_by(member, best).alias("l"), F.count("*").alias("length")).where("c1 <> c2")
        ends = (F.least("o.set_id", "l.set_id").alias("a"), F.greatest("o.set_id", "l.set_id").alias("b"))
        sizes = (F.least("o.n", "l.n").alias("n"), F.greatest("o.n", "l.n").alias("m"))
        apart = F.expr(f"o.component <> l.component and {DEN} * least(o.n, l.n) >= {NUM} * greatest(o.n, l.n)")
        if step < LEADERS:
            pairs = mine.join(mixed.select("key", "l"), "key").select(member.alias("o"), "l").where(apart)
            pairs = pairs.groupBy(*ends, *sizes).agg(F.count("*").alias("lists")).where(f"lists >= 1 + n div {SHARE}").select("a", "b")
        else:
            pairs = _last_pairs(work, mine.join(mixed.select("key", "length"), "key"), apart, ends, sizes)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = work.write(pairs, f"pairs_{step}")
        if pairs.isEmpty():
            continue
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        chosen = named.join(wanted, "set_id").groupBy("set_id").agg(first_doc.alias("_id"))
        chosen = work.write(chosen, f"chosen_{step}")
        if work.size(f"chosen_{step}") <= BROADCAST:
            chosen = F.broadcast(chosen)
        sets = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["_id"])).select("set_id", "text").mapInArrow(_sets(k), "set_id long, grams binary")
        sets = work.write(sets, f"sets_{step}")
        both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("grams").alias("x")), "a")
        both = both.join(sets.select(F.col("set_id").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
        checked = work.write(both.mapInArrow(_verified, "a long, b long, linked boolean").distinct(), f"checked_{step}")
        work.drop(f"sets_{step}")
        work.release()
        tried = checked.select("a", "b") if tried is None else tried.unionByName(checked.select("a", "b"))
        fresh = checked.where("linked")
        for end in ("a", "b"):  # links between components
            named_end = labels.select(F.col("node").alias(end), F.col("component").alias("_c"))
            fresh = fresh.join(named_end, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
        merged = components(work, fresh.select("a", "b"), f"components_{step + 1}")
        merged = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        old = labels.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        new = merged.select(F.col("component").alias("node"), F.col("_to").alias("component")).join(labels.select("node"), "node", "left_anti")
        labels = work.write(old.unionByName(new), f"labels_{step + 1}")

    # back to documents
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    least_id = named.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min(row).alias("row"), F.count("*").alias("copies"))
    least_id = least_id.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    groups = least_id.groupBy("component").agg(F.min("least").alias("component_id"), F.min("row").alias("_first"), F.sum("copies").alias("texts")).where("texts > 1")
    known = work.write(least_id.join(groups, "component").select("set_id", "component_id", "_first"), "known")
    work.keep("named", "known")
    out = named.join(known.withColumn("_n", F.lit(True)), "set_id", "left")
    has = (F.col("n") > 0) & F.col("_n")
    component_id = F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id, "text_key", F.when(has, row == F.col("_first")).alias("first"))

