"""Repair of conversations' structure: the cheapest edits, as an audit, to the roles ``(s?(ua)+)?``.

Rows of a conversation are kept (K), given another role (R), deleted (D), and empty turns are inserted (I). A dynamic
program runs over rows and the four places that a legal conversation can be in (at its start, after the system turn,
after a user's, after an assistant's). Each place holds its cheapest audit so far, and of equally cheap ones
the least in ASCII. Audits are persistent: an edit is a node that points to the one before, so audits share their
prefixes; a node has binary-lifting ancestors and the rolling hash of its audit. Ties are decided by the longest
common prefix, found by lifting both sides over ancestors whose hashes differ; what hashes call equal is verified by
walking both sides to the node that they share.

At scale: a conversation of at most ``ROWS`` rows and ``BYTES`` of text is repaired in one pass over its sorted rows.
Longer ones, which may hold any part of all rows, are cut into ranges of their order, without their texts and with equal rows
combined. Each range gives a table of its cheapest audits from every place to every place; tables are put together in
order. Ties between audits are decided alike, since no cheapest audit of some rows is the beginning of another to the same
place. What is a chain by definition, the SHA-256 of the repaired conversation, reads its rows in order in bounded memory.

Edge cases: null roles and texts are one space (so such a text is blank, such a role neither s, u nor a); null turns stand
first and make no gaps; rows of one turn go by role, then by the SHA-256 of their text; a null conv_id is a conversation
of its own; a conversation of no rows has zeros, an empty audit and the empty string's hash; an empty table
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._places import long_keys, sorting
from tallyloom.llm._shared import Workspace

#: Conversations of more rows or bytes of text are repaired by many tasks.
ROWS, BYTES = 20_000, 16 << 20
#: Rows of one table of audits.
SPAN = 20_000
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Places, and where each role leads from them: system opens, a user's turn follows all but a user's, an assistant's a user's.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = frozenset(("su", "ua", "au"))
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
SPACE = r"\x20\x09-\x0D"


class Audits:
    """A forest of edits in which node 0 is the empty audit."""

    def __init__(self):
        self.up: list[list[int]] = [[0]]
        self.edit, self.hash, self.size = [""], [0], [0]

    def then(self, node: int, edit: str) -> int:
        """The audit of a node and one more edit."""
        new, up, at, k = len(self.edit), [node], node, 0
        while k < len(self.up[at]) and at:
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.up.append(up)
        self.edit.append(edit)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % _PRIME)
        self.size.append(self.size[node] + 1)
        return new

    def first(self, node: int, size: int) -> int:
        """The ancestor that holds the first ``size`` edits."""
        k = len(self.up[node]) - 1
        while self.size[node] > size:
            while k >= len(self.up[node]) or self.size[self.up[node][k]] < size:
                k -= 1
            node = self.up[node][k]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's audit stands before b's."""
        size = min(self.size[a], self.size[b])
        x, y = self.first(a, size), self.first(b, size)
        if self.hash[x] != self.hash[y]:
            k = len(self.up[x]) - 1
            while k >= 0:  # up to the first edits that differ
                if k < len(self.up[x]) and k < len(self.up[y]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
                k -= 1
            differ = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        else:
            differ = None
        while x != y:  # what the hashes call equal is looked at
            if self.edit[x] != self.edit[y]:
                differ = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        if differ is None:
            return self.size[a] < self.size[b]
        return self.edit[differ[0]] < self.edit[differ[1]]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


#: A place's best: (cost, node of its audit).
Best = dict[int, tuple[int, int]]


def _offer(audits: Audits, best: Best, place: int, cost: int, node: int, edit: str) -> None:
    now = best.get(place)
    if now is None or cost < now[0]:
        best[place] = (cost, audits.then(node, edit))
    elif cost == now[0]:
        new = audits.then(node, edit)
        if audits.less(new, now[1]):
            best[place] = (cost, new)


def _inserted(audits: Audits, best: Best) -> Best:
    """With turns inserted: a user's, and then perhaps an assistant's; more of them lead to no new place."""
    out = dict(best)
    for p in (START, SYSTEM, ASSISTANT):
        if p in best:
            _offer(audits, out, USER, best[p][0] + INSERT, best[p][1], "I")
    if USER in out:
        _offer(audits, out, ASSISTANT, out[USER][0] + INSERT, out[USER][1], "I")
    return out


def _after(place: int, initial: str) -> int | None:
    """Where a kept row leads, if it may stand here."""
    if initial == "s":
        return SYSTEM if place == START else None
    if initial == "u":
        return USER if place != USER else None
    return ASSISTANT if initial == "a" and place == USER else None


def advance(audits: Audits, best: Best, initial: str, fault: str) -> Best:
    """One row on. fault: b(lank), d(uplicate), t(runcated) or empty."""
    out: Best = {}
    for p, (cost, node) in best.items():
        _offer(audits, out, p, cost + DELETE, node, "D")
        if fault in ("", "t"):
            more = cost + CUT * (fault == "t")
            to = _after(p, initial)
            if to is not None:
                _offer(audits, out, to, more + KEEP, node, "K")
            _offer(audits, out, USER if p != USER else ASSISTANT, more + REROLE, node, "R")
    return _inserted(audits, out)


def begun(audits: Audits, place: int = START) -> Best:
    return _inserted(audits, {place: (0, 0)})


def cheapest(audits: Audits, best: Best) -> tuple[int, str]:
    """Cost and audit of the best legal end."""
    found = None
    for p in (START, ASSISTANT):
        if p in best and (found is None or best[p][0] < found[0] or best[p][0] == found[0] and audits.less(best[p][1], found[1])):
            found = best[p]
    return found[0], audits.text(found[1])


class Repaired:
    """The repaired turns of an audit, hashed as rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.any, self.hash = audit, 0, START, False, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def _next(self) -> str:
        """The role that an inserted or changed turn gets."""
        self.place, role = (ASSISTANT, "assistant") if self.place == USER else (USER, "user")
        return role

    def _insert(self) -> None:
        while self.audit.startswith("I", self.at):
            self._put(self._next(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = _after(self.place, role[:1])
            self._put(role, text)
        elif edit == "R":
            self._put(self._next(), text)

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def repaired(rows: list[tuple[str, str]], audit: str) -> str:
    """The hash of (role, text) rows repaired by an audit."""
    out = Repaired(audit)
    for role, text in rows:
        out.row(role, text)
    return out.digest()


class _Counts:
    """Gaps, faults and illegal neighbours, row by row; put together in order."""

    def __init__(self):
        self.least = self.most = self.last = None
        self.distinct = self.illegal = 0
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.head = self.tail = None  # role initials

    def row(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.least, self.most, self.last = turn if self.least is None else self.least, turn, turn

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.distinct

    def result(self) -> list[int]:
        return [self.gaps(), self.faults["b"], self.faults["d"], self.faults["t"], self.illegal]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that a hash of conv_id and turn deals: rows of which none is left have null roles."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("damage"),
    )
    role = F.when(F.col("damage") == 4, "user").when(F.col("damage") != 0, F.col("role"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("damage") != 0, F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    """With key (SHA-256 of the text) and state: b(lank), t(runcated) or empty. Rows of null roles stand for none."""
    last = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    state = F.when(last == "", "b").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return rows.withColumns({"key": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "state": state})


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, bool, dict | None]]:
    """(key, whether it is new, row) of sorted rows; at the end a row of None."""
    now, seen = None, False
    for b in batches:
        columns = {n: b.column(n).to_pylist() for n in b.schema.names}
        for row in zip(*columns.values(), strict=True):
            row = dict(zip(columns, row, strict=True))
            new = not seen or row[key] != now
            now, seen = row[key], True
            yield now, new, row
    yield None, True, None


def _emit(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


_LONGS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = pa.schema([(n, pa.int64()) for n in _LONGS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that fit a task, each by itself: sorted rows (conv_id, turn, role, text, key, state)."""
    rows, conv, out = [], None, []

    def done() -> tuple:
        counts, audits, seen = _Counts(), Audits(), set()
        best = begun(audits)
        for turn, role, _, key, state in rows:
            fault = "b" if state == "b" else "d" if (role, key) in seen else state
            seen.add((role, key))
            counts.row(turn, role[:1], fault)
            best = advance(audits, best, role[:1], fault)
        cost, audit = cheapest(audits, best)
        return (conv, *counts.result(), cost, audit, repaired([(r[1], r[2]) for r in rows], audit))

    started = False
    for key, new, row in _runs(batches, "conv_id"):
        if new:
            if started:
                out.append(done())
            if len(out) >= 4096 or row is None:
                yield _emit(out, _RESULT)
                out = []
            conv, rows, started = key, [], True
        if row is not None and row["role"] is not None:
            rows.append((row["turn"], row["role"], row["text"], row["key"], row["state"]))


_SEGMENT = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64())]
    + [(n, pa.int64()) for n in ("least", "most", "last", "distinct", "illegal", "b", "d", "t")]
    + [("head", pa.string()), ("tail", pa.string()), ("first_turn", pa.int64())]
    + [("from_", pa.int64()), ("to_", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
)
_SEGMENT_SQL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _SEGMENT)


def _segments(span: int):
    """Of sorted narrow rows (conv_id, turn, initial, fault, copies, part): for each run of a conversation's rows its counts and the
    cheapest audits between all places, a row for each pair of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, conv, part, seq = [], None, None, 0

        def done() -> list[tuple]:
            counts, out = _Counts(), []
            for turn, initial, fault in rows:
                counts.row(turn, initial, fault)
            head = (conv, part, seq, counts.least, counts.most, counts.last, counts.distinct, counts.illegal, *(counts.faults[x] for x in "bdt"), counts.head, counts.tail, counts.least)
            for place in range(4):
                audits = Audits()
                best = begun(audits, place)
                for _, initial, fault in rows:
                    best = advance(audits, best, initial, fault)
                out += [(*head, place, to, cost, audits.text(node)) for to, (cost, node) in best.items()]
            return out

        for key, new, row in _runs(batches, "conv_id"):
            if (new or len(rows) >= span) and rows:
                yield _emit(done(), _SEGMENT)
                rows, seq = [], seq + 1
            if row is None:
                break
            conv, part = key, row["part"]
            for i in range(row["copies"]):
                rows.append((row["turn"], row["initial"], "d" if i and row["fault"] != "b" else row["fault"]))
                if len(rows) >= span:
                    yield _emit(done(), _SEGMENT)
                    rows, seq = [], seq + 1

    return run


_FOLDED = pa.schema(list(_RESULT)[:-1])


class _Fold:
    """A long conversation's tables put together. Live audits are kept without the beginning that all of them share."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.shared = conv, _Counts(), []
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, table: list[dict]) -> None:
        c, x = self.counts, table[0]
        for k in "bdt":
            c.faults[k] += x[k]
        if c.tail is not None and c.tail + x["head"] not in LEGAL:
            c.illegal += 1
        c.illegal, c.tail = c.illegal + x["illegal"], x["tail"]
        c.distinct += x["distinct"] - (x["first_turn"] is not None and x["first_turn"] == c.last)
        if x["least"] is not None:
            c.least, c.most, c.last = x["least"] if c.least is None else c.least, x["most"], x["last"]
        best: dict[int, tuple[int, str]] = {}
        for r in table:
            if r["from_"] in self.best:
                cost, audit = self.best[r["from_"]]
                new = (cost + r["cost"], audit + r["audit"])
                if r["to_"] not in best or new < best[r["to_"]]:
                    best[r["to_"]] = new
        n = _common([a for _, a in best.values()])
        self.shared.append(next(iter(best.values()))[1][:n])
        self.best = {p: (c, a[n:]) for p, (c, a) in best.items()}

    def result(self) -> tuple:
        cost, audit = min(self.best[p] for p in (START, ASSISTANT) if p in self.best)
        return (self.conv, *self.counts.result(), cost, "".join(self.shared) + audit)


def _common(texts: list[str]) -> int:
    """How many characters all texts begin with in common."""
    a, b = min(texts), max(texts)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, table, place = None, [], None
    for conv, new, row in _runs(batches, "conv_id"):
        at = row and (row["part"], row["seq"])
        if table and (new or at != place):
            fold.add(table)
            table = []
        if new:
            if fold is not None:
                yield _emit([fold.result()], _FOLDED)
            fold = _Fold(conv)
        if row is not None:
            table.append(row)
            place = at


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of long conversations, each conversation's audit first: its repaired rows hashed as they come."""
    head = out = None
    for _, new, row in _runs(batches, "conv_id"):
        if new and head is not None:
            yield _emit([(*head, out.digest())], _RESULT)
        if row is None:
            break
        if new:
            head = tuple(row[n] for n in (*_LONGS, "audit"))
            out = Repaired(row["audit"])
        else:
            out.row(row["role"], row["text"])


def _long(work: Workspace, rows: DataFrame) -> DataFrame:
    """``repair`` of conversations of any size, rows judged."""
    rows = rows.where("role is not null").select("conv_id", "turn", "role", "key", "state", "text")
    same = rows.groupBy("conv_id", "turn", "role", "key", "state").agg(F.count("*").alias("copies"))
    same = work.write(same, "same")
    first = same.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("key").alias("k_"), "first")
    met = same.join(first, same["conv_id"].eqNullSafe(first["c_"]) & (same["role"] == first["r_"]) & (same["key"] == first["k_"]), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("state") == "b", "b").when(later, "d").otherwise(F.col("state"))
    narrow = met.select("conv_id", "turn", "role", "key", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")
    order = sorting(["conv_id", "turn", "role", "key"])
    dealt = work.write(narrow, "narrow").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    tables = work.write(dealt.select("conv_id", "turn", "initial", "fault", "copies", "part").mapInArrow(_segments(SPAN), _SEGMENT_SQL), "tables")
    folded = tables.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_folded, ", ".join(f"{n} long" for n in _LONGS) + ", audit string")
    folded = work.write(folded, "folded")
    both = folded.withColumn("kind", F.lit(0)).unionByName(rows.select("conv_id", "turn", "role", "key", "text").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *sorting(["turn", "role", "key"]))
    return both.select(*_LONGS, "audit", "role", "text").mapInArrow(_hashed, RESULT)


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row (``RESULT``) for each conversation of rows (conv_id, turn, role, text); rows with a null role name a conversation only."""
    work = Workspace(spark, "structure_repair")
    large = long_keys(work, rows.where("role is not null"), "conv_id", ROWS, F.octet_length("text"), BYTES)
    judged = _judged(rows)
    order = ["conv_id", "turn", "role", "key"]
    small = judged if large is None else judged.join(large, judged["conv_id"].eqNullSafe(large["long_"]), "left_anti")
    small = small.repartition("conv_id").sortWithinPartitions(*sorting(order)).select("conv_id", "turn", "role", "text", "key", "state").mapInArrow(_whole, RESULT)
    if large is None:
        return small
    return small.unionByName(_long(work, judged.join(large, judged["conv_id"].eqNullSafe(large["long_"]), "left_semi")))


def repair_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``repair`` of conversations as they are: null roles and texts are one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return repair(spark, conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled))
