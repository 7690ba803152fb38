"""Prefix tries of conversations: every distinct sequence of first turns is a node.

Turns become ids (128 bits of SHA-256 of role and text, and the text's number of words). A block lays the ids of
some consecutive positions out in columns, one row for each conversation; ``ROLLUP`` over these columns, with
``grouping_id`` for the depth, aggregates all prefixes of the block together. Conversations that go on share the
next block with those that have met in the same node: its rows are grouped by that node first (by its least
member) and rolled up within. The first block has ``WIDTHS[0]`` columns, later ones more. A conversation that is alone in
the node where a block ends shares no longer prefix, so no later block has it: its further nodes are chains, one a turn.

Sums over subtrees need no walk of the tree. A node's leaves are those conversations among its members that
represent a leaf (as its least member). The tokens saved in a subtree are those that its members have there less those of its
nodes; each node counts with the conversation that represents it, and a conversation represents the nodes from some
depth of its path on to its end. So both are sums over members of figures that each conversation has by itself, and a
second ``ROLLUP`` adds them up.

At scale: blocks are aggregated before they are shuffled, so a first turn that all conversations share costs each task one row;
hot parents and ends meet their children in joins whose one side has unique keys, which Spark splits. The driver holds one
number a block; there are as many blocks as the longest prefix that two conversations share asks for. A node's members that
end there are hashed one after the other in bounded memory (SHA-256 is a chain; ids of 10 bytes or so).

Edge cases: null roles and texts are empty; rows without conv_id are no conversation's and left out; null turns stand first,
and rows of one turn go by their ids; rows that repeat are turns of their own; conversations without turns are members of the root,
which is there if any conversation is; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._places import numbered
from tallyloom.llm._shared import Workspace

#: Columns of the first blocks; those after them have as many as the last (Spark takes 64 grouping sets at most).
WIDTHS = (8, 16, 32, 48)
#: Turns of a conversation that one task numbers; longer ones are numbered by many.
MOST = 100_000
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, step): step is 16 bytes of SHA-256 of the role's length, role and text, then the number of words in 5."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")), 10, "0")
    found = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.concat(digest, words)).alias("step"))
    return found.where("conv_id is not null")


def placed(work: Workspace, ids: DataFrame) -> DataFrame:
    """``turn_ids`` with place, from 0, by turn; written."""
    return work.write(numbered(work, ids, "conv_id", ["turn", "step"], MOST).select("conv_id", "place", "step"), "placed")


def lent(work: Workspace, turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of another: (conv_id, n), and (conv_id, depth, step), both written.

    Conversation c begins with the first h turns of c - c % group (h: CRC-32 of c in decimals, modulo ``most``),
    as many as that has, and goes on with its own after its first h.
    """
    own = turns.groupBy("conv_id").count()
    own = own.select("conv_id", F.col("count").alias("own"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    own = own.withColumn("h", F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.col("h")))  # its own first turns are what it has
    sizes = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    found = own.join(sizes, "base", "left").withColumn("got", F.least("h", F.coalesce("there", F.lit(0))))
    found = work.write(found.select("conv_id", "base", "h", "got", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "rebuilt")
    firsts = turns.where(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "place", "step")
    taken = found.where("got > 0").join(firsts, "base").where("place < got").select("conv_id", (F.col("place") + 1).alias("depth"), "step")
    rest = turns.join(found, "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("got") + 1).alias("depth"), "step")
    return found.select("conv_id", "n"), work.write(taken.unionByName(rest), "steps")


def _words(step: str) -> str:
    return f"cast(conv(hex(substring({step}, 17, 5)), 16, 10) as bigint)"


def _path(k: int, upto: str | None = None) -> str:
    """SQL of a key of the node that the columns t1 to tk spell, or those up to a number."""
    of = (lambda i: f"coalesce(t{i}, x'')") if upto is None else (lambda i: f"if({upto} >= {i}, coalesce(t{i}, x''), x'')")
    return f"unhex(substring(sha2(concat(cast(coalesce(prev || '|', '') as binary), {', '.join(of(i) for i in range(1, k + 1))}), 256), 1, 32))"


def _rolled(spark: SparkSession, block: DataFrame, lo: int, k: int, sums: dict[str, str]) -> DataFrame:
    """The nodes of a block: (depth, above: words before the node's last turn, words: in that, path, parent_path, given: the
    parent of a later block's first nodes) and the sums.

    A grouping set whose last column is null is of conversations that end before it: no node. The set of no columns is the
    node where the block begins: the root's in the first block, an earlier block's in others.
    """
    cols = ", ".join(f"t{i}" for i in range(1, k + 1))
    rolled = spark.sql(f"select prev, {cols}, {k} - bit_count(grouping_id()) as j, max(above) as before, {', '.join(f'{v} as {n}' for n, v in sums.items())} from {{block}} group by prev, rollup({cols})", block=block)
    last = "case j " + " ".join(f"when {i} then t{i}" for i in range(1, k + 1)) + " end"
    above = " + ".join(["before", *(f"if(j > {i}, {_words(f't{i}')}, 0)" for i in range(1, k))])
    rolled = rolled.where(f"{last} is not null" + (" or j = 0" if lo == 0 else ""))
    given = f"if(j = 1 and {lo} > 0, cast(substring_index(prev, ':', -1) as bigint), null) as given"
    parent = f"if(j = 0 or j = 1 and {lo} > 0, {_path(k)}, {_path(k, 'j - 1')}) as parent_path"
    return rolled.selectExpr(f"cast(j + {lo} as bigint) as depth", f"{above} as above", f"coalesce({_words(last)}, 0) as words", f"{_path(k)} as path", parent, given, *sums)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha) of the sorted (path, conv_id): the ids of each path, comma-joined and hashed as they come."""
    key, h, out = None, None, ([], [])
    for b in batches:
        for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p != key:
                if h is not None:
                    out[0].append(key)
                    out[1].append(h.hexdigest())
                key, h = p, hashlib.sha256(str(c).encode())
            else:
                h.update(b",%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["path", "sha"])
        out = ([], [])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["path", "sha"])


def trie(work: Workspace, members: DataFrame, steps: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The nodes (``COLUMNS``) of conversations members (conv_id, n turns) with steps (conv_id, depth from 1, step)."""
    spark, lo, b = work.spark, 0, 0
    longest = members.agg(F.max("n")).first()[0] or 0
    active = members.select("conv_id", "n", F.lit(None).cast("string").alias("prev"), F.lit(0).cast("long").alias("above"))
    blocks, nodes, ends, tails = [], [], [], []
    while True:
        k = widths[min(b, len(widths) - 1)]
        ts = [f"t{i}" for i in range(1, k + 1)]
        these = steps.where((F.col("depth") > lo) & (F.col("depth") <= lo + k)).select("conv_id", "depth", "step")
        laid = active.withColumns({"depth": F.lit(0), "step": F.lit(None).cast("binary")}).unionByName(these, allowMissingColumns=True)
        laid = laid.groupBy("conv_id").agg(*[F.max(x).alias(x) for x in ("n", "prev", "above")], *[F.max(F.when(F.col("depth") == lo + i + 1, F.col("step"))).alias(t) for i, t in enumerate(ts)])
        block = work.write(laid.where("n is not null"), f"block_{b}")
        found = _rolled(spark, block, lo, k, {"conv_id": "min(conv_id)", "n_convs": "count(*)"})
        found = work.write(found, f"nodes_{b}")
        blocks.append((block, lo, k))
        nodes.append(found)
        ends.append(block.where((F.col("n") <= lo + k)).selectExpr(f"{_path(k)} as path", "conv_id"))
        if longest <= lo + k:
            break
        last = found.where(f"depth = {lo + k}").select("path", F.col("conv_id").alias("node"), "n_convs")
        on = block.where(F.col("n") > lo + k).selectExpr("conv_id", "n", "above + " + " + ".join(_words(t) for t in ts) + " as above", f"{_path(k)} as path").join(last, "path")
        on = work.write(on.select("conv_id", "n", F.concat(F.lit(f"{lo + k}:"), F.col("node").cast("string")).alias("prev"), "above", "n_convs"), f"on_{b}")
        alone = on.where("n_convs = 1").select("conv_id", F.col("n").alias("end"), F.lit(lo + k).alias("from"))
        tails.append(steps.join(alone, "conv_id").where("depth > from").selectExpr("conv_id", "depth", "end", f"{_words('step')} as words"))
        active = on.where("n_convs > 1").drop("n_convs")
        lo, b, longest = lo + k, b + 1, active.agg(F.max("n")).first()[0]
        if longest is None:
            break
    return _summed(work, steps, blocks, nodes, ends, tails)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _summed(work: Workspace, steps: DataFrame, blocks: list, nodes: list, ends: list, tails: list) -> DataFrame:
    """Parents, children and what the subtrees sum up to."""
    every = _union(nodes)
    parents = every.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("up"))
    tree = every.join(parents, "parent_path", "left")
    tree = tree.select("conv_id", "depth", "words", "path", F.coalesce("given", "up").alias("parent_conv_id"))
    tree = work.write(tree.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id"))), "tree")
    tail = work.write(_union(tails), "tail") if tails else None
    child = tree.select(F.col("parent_conv_id").alias("conv_id"), F.col("depth") - 1).toDF("conv_id", "depth").where("conv_id is not null")
    if tail is not None:
        child = child.unionByName(tail.select("conv_id", (F.col("depth") - 1).alias("depth")))
    kids = child.groupBy("conv_id", "depth").agg(F.count("*").alias("n_children"))
    counted = work.write(tree.join(kids, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "counted")
    # each conversation by itself: its words, those of the nodes it represents, whether it represents a leaf
    own = [steps.selectExpr("conv_id", f"{_words('step')} as t", "0L as r", "0L as leaf"), counted.selectExpr("conv_id", "0L as t", "words as r", "if(n_children = 0, 1L, 0L) as leaf")]
    if tail is not None:
        own.append(tail.selectExpr("conv_id", "0L as t", "words as r", "if(depth = end, 1L, 0L) as leaf"))
    own = work.write(_union(own).groupBy("conv_id").agg(F.sum("t").alias("t"), F.sum("r").alias("r"), F.sum("leaf").alias("leaf")), "own")
    sums = {"m": "min(struct(conv_id, t, r))", "n_convs": "count(*)", "t": "sum(t)", "r": "sum(r)", "n_leaves": "sum(leaf)"}
    rolled = _union([_rolled(work.spark, block.join(own, "conv_id", "left").fillna(0, ["t", "r", "leaf"]), lo, k, sums) for block, lo, k in blocks])
    saved = "t - n_convs * above - (r - m.r + m.t - above)"
    rolled = rolled.selectExpr("m.conv_id as conv_id", "depth", "n_convs", "n_leaves", f"{saved} as saved_tokens")
    ended = _union(ends).repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(_digests, "path binary, sha string")
    out = rolled.join(counted, ["conv_id", "depth"]).join(ended, "path", "left")
    out = out.select(*COLUMNS[:-1], F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))
    if tail is not None:
        last = F.col("depth") == F.col("end")
        figures = {"parent_conv_id": F.col("conv_id"), "n_convs": F.lit(1), "n_children": F.when(last, 0).otherwise(1), "n_leaves": F.lit(1), "saved_tokens": F.lit(0)}
        sha = F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_EMPTY)
        out = out.unionByName(tail.select("conv_id", "depth", *[v.cast("long").alias(n) for n, v in figures.items()], sha.alias("ends_sha256")))
    return out.select(*[F.col(c).cast("long").alias(c) for c in COLUMNS[:-1]], "ends_sha256")


def of_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    work = Workspace(spark, "prefix_trie")
    turns = placed(work, turn_ids(conversations))
    return trie(work, turns.groupBy("conv_id").agg(F.count("*").alias("n")), turns.select("conv_id", (F.col("place") + 1).alias("depth"), "step"))


def of_lent(spark: SparkSession, conversations: DataFrame, group: int = 20, most: int = 4, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The trie of conversations rebuilt on the first turns of others (``lent``)."""
    work = Workspace(spark, "prefix_trie")
    members, steps = lent(work, placed(work, turn_ids(conversations)), group, most)
    return trie(work, members, steps, widths)
