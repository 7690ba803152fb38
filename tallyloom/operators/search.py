"""Search over all sources of a call together: arguments as users type them, one budget of bytes and lines, hints for exact reads.

Each source is scanned by itself, where its body is: a scan keeps a few KiB of lines to show, the counts, and where the first match is. Only
that is shuffled, and the scans of one call (two at most) are rendered together. A rendering over the budget is shrunk: context goes from the
source that shows the widest, a line at a time, then matches from the source that shows the most.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.archive import LINE_BYTES, RENDERED, SOURCE_BYTES, Search
from tallyloom.operators.batches import bound
from tallyloom.operators.lines import Escapes

# Fixed values.
RECORDS, LINE_MOST, MOST_CONTEXT, MOST_RESULTS = 2048, 1 << 20, 50, 100
BYTES, LINES = 32_768, 1900
COMPLETE = {"complete": "true", "incomplete": "false", "unknown": "unknown"}
SOURCES = ("stdout", "stderr", "result_text", "source_output")
_FLAGS = {"-F": "fixed", "--fixed-strings": "fixed", "-i": "fold", "--ignore-case": "fold", "-w": "word", "--word-regexp": "word", "-v": "invert", "--invert-match": "invert"}
_COUNTS = {
    "-A": ("after",), "--after-context": ("after",), "-B": ("before",), "--before-context": ("before",), "-C": ("before", "after"), "--context": ("before", "after"),
    "-m": ("limit",), "--max-results": ("limit",),
}


class Usage(ValueError):
    """Arguments that aren't a search or a read, and why."""


def whole_number(text: str) -> int:
    """A number without signs and leading zeros."""
    if not (text.isascii() and text.isdigit()) or len(text) > 1 and text[0] == "0":
        raise Usage(f"{text!r} is no plain number")
    return int(text)


def parse(arguments: Sequence[str]) -> tuple[str, Search]:
    """(reference, search) of REF PATTERN [options] or REF -e PATTERN ... [options]. An option twice with two values is refused."""
    loose, patterns, given, rest = [], [], {}, deque(arguments)
    while rest:
        a = rest.popleft()
        if a == "--":
            loose += rest
            break
        if a in _FLAGS:
            given[_FLAGS[a]] = True
        elif a in ("-e", "--regexp") or a in _COUNTS:
            if not rest:
                raise Usage(f"{a} needs a value")
            value = rest.popleft()
            if a not in _COUNTS:
                patterns.append(value)
                continue
            n, least, most = whole_number(value), *((1, MOST_RESULTS) if _COUNTS[a] == ("limit",) else (0, MOST_CONTEXT))
            if not least <= n <= most:
                raise Usage(f"{a} takes {least} to {most}")
            for name in _COUNTS[a]:
                if given.setdefault(name, n) != n:
                    raise Usage(f"two values for {name}")
        elif a.startswith("-"):
            raise Usage(f"no option {a}")
        else:
            loose.append(a)
    if not loose:
        raise Usage("no reference")
    if patterns and len(loose) > 1:
        raise Usage("a pattern beside -e")
    if len(loose) > 2:
        raise Usage("more than one pattern")
    patterns += loose[1:]
    if not patterns:
        raise Usage("no pattern")
    try:
        return loose[0], Search(tuple(patterns), **given)
    except ValueError as e:
        raise Usage(str(e)) from None


def parse_read(arguments: Sequence[str]) -> tuple[str, str | None, str, int, int]:
    """(reference, source, lines or bytes, start, end) of REF [SOURCE] START:END or REF SOURCE --bytes START:END."""
    if len(arguments) == 4 and arguments[2] == "--bytes":
        unit, source = "bytes", arguments[1]
    elif len(arguments) in (2, 3):
        unit, source = "lines", arguments[1] if len(arguments) == 3 else None
    else:
        raise Usage("not REF [SOURCE] START:END")
    start, colon, end = arguments[-1].partition(":")
    if not colon:
        raise Usage("no START:END")
    a, b = whole_number(start), whole_number(end)
    if a < (unit == "lines") or b < a:
        raise Usage("a range that isn't one")
    return arguments[0], source, unit, a, b


def normalised(line: bytes) -> str:
    """A line without its end, control characters spelled out."""
    text = line.removesuffix(b"\r").decode()
    if text.isprintable():
        return text
    return "".join(c if c == "\t" or not (ord(c) < 32 or 127 <= ord(c) < 160) else f"\\x{ord(c):02x}" if ord(c) < 128 else f"\\u{{{ord(c):x}}}" for c in text)


def fitted(text: str, most: int) -> str:
    """A text within so many bytes, three dots for what is left out."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "..."


@dataclass
class Scan:
    """What a search found in one source, and what it may show of it."""

    name: str
    completeness: str
    before: int
    after: int
    limit: int
    lines: int = 0
    selected: int = 0
    first: int | None = None
    shown: list[int] = field(default_factory=list)
    store: dict[int, str] = field(default_factory=dict)

    def groups(self) -> list[list[int]]:
        """From and to of the runs of lines around what is shown; runs that touch are one."""
        out: list[list[int]] = []
        for n in self.shown:
            a, b = max(1, n - self.before), min(self.lines, n + self.after)
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out


def scan(name: str, completeness: str | None, raw: bytes, s: Search) -> Scan:
    """Search one source; a line of more than 1 MiB, or bytes that are no text, can't be searched."""
    out = Scan(name, completeness or "complete", s.before, s.after, s.limit)
    pattern, escapes, used, due = s.compiled(), Escapes(), 0, 0
    previous: deque[tuple[int, str]] = deque(maxlen=s.before)

    def keep(n: int, text: str) -> bool:
        nonlocal used
        if n not in out.store:
            text = fitted(text, LINE_BYTES)
            size = len(text.encode())
            if len(out.store) >= RECORDS or used + size > SOURCE_BYTES:
                return False
            used += size
            out.store[n] = text
        return True

    at = 0
    while at < len(raw):
        end = raw.find(b"\n", at) + 1 or len(raw)
        if end - at > LINE_MOST:
            raise Usage(f"{name} has a line of more than {LINE_MOST} bytes: read it by bytes")
        piece = escapes.push(raw[at:end])
        at, n = end, out.lines + 1
        out.lines = n
        try:
            text = normalised(piece.removesuffix(b"\n"))
        except UnicodeDecodeError:
            raise Usage(f"{name} is no text: read it by bytes") from None
        if due:
            keep(n, text)
            due -= 1
        if bool(pattern.search(text.encode())) != s.invert:
            out.selected += 1
            out.first = out.first or n
            if len(out.shown) < min(s.limit, RENDERED) and keep(n, text):
                for k, t in previous:
                    keep(k, t)
                out.shown.append(n)
                due = s.after
        previous.append((n, text))
    return out


def render(ref: str, scans: list[Scan], width: int) -> str:
    """All sources' matches with ``:``, their context with ``-``, ``--`` between groups and sources; counts, and how to read what is there exactly."""
    if not any(x.shown for x in scans):
        total, hit = sum(x.selected for x in scans), next((x for x in scans if x.first), None)
        return f"[search: ref={ref}; matches={total}; showing=0; omitted={total}; first={hit.name}:{hit.first}; read=read {ref} {hit.name} {hit.first}:{hit.first}]\n" if hit else ""
    out = [f"[search: ref={ref}]\n"]
    for i, x in enumerate(scans):
        out += ["--\n"] * (i > 0)
        out.append(f"[source={x.name} complete={COMPLETE[x.completeness]} matches={x.selected} showing={len(x.shown)} before={x.before} after={x.after} max_results={x.limit}]\n")
        groups, hits = x.groups(), set(x.shown)
        for k, (a, b) in enumerate(groups):
            out += ["--\n"] * (k > 0)
            for n in range(a, b + 1):
                if n in x.store:
                    mark = ":" if n in hits else "-"
                    out.append(f"{x.name}{mark}{n}{mark}{fitted(x.store[n], width)}\n")
        if x.selected > len(x.shown):
            out.append(f"[search: {x.selected - len(x.shown)} selected line(s) omitted]\n")
        out += [f"Read exact context: read {ref} {x.name} {a}:{b}\n" for a, b in groups]
    return "".join(out)


def shrunk(scans: list[Scan]) -> Iterator[None]:
    """Take away a line of the widest context, again and again, then a match of the source that shows the most; ends when nothing is left."""
    heap = [(-(x.before + x.after), -i) for i, x in enumerate(scans)]
    heapq.heapify(heap)
    while heap and heap[0][0] < 0:
        x = scans[-heap[0][1]]
        if x.after >= x.before:
            x.after -= 1
        else:
            x.before -= 1
        heapq.heapreplace(heap, (-(x.before + x.after), heap[0][1]))
        yield
    heap = [(-len(x.shown), -i) for i, x in enumerate(scans)]
    heapq.heapify(heap)
    while heap and heap[0][0] < 0:
        x = scans[-heap[0][1]]
        x.shown.pop()
        heapq.heapreplace(heap, (-len(x.shown), heap[0][1]))
        yield


def rendered(ref: str, scans: list[Scan], most_bytes: int = BYTES, most_lines: int = LINES) -> str:
    """The rendering within its budget."""
    width, steps = min(LINE_BYTES, max(64, most_bytes // 2)), shrunk(scans)
    while True:
        text = render(ref, scans, width)
        if len(text.encode()) <= most_bytes and text.count("\n") <= most_lines:
            return text
        if next(steps, "over") == "over":
            raise Usage(f"nothing fits {most_bytes} bytes and {most_lines} lines")


def joint(found: DataFrame, s: Search, most_bytes: int = BYTES, most_lines: int = LINES) -> DataFrame:
    """call_key, matches, first, rendering, error of every call of sources (call_key, archive_ref, subject, completeness, body) with a match.

    An error in one source is the call's: nothing of it is shown.
    """

    def scans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, ref, subject, completeness, raw in b[["call_key", "archive_ref", "subject", "completeness", "body"]].itertuples(index=False):
                try:
                    rows.append((key, ref, SOURCES.index(subject), json.dumps(asdict(scan(subject, completeness, bytes(raw), s))), None))
                except Usage as e:
                    rows.append((key, ref, SOURCES.index(subject), None, str(e)))
            yield pd.DataFrame(rows, columns=["call_key", "archive_ref", "place", "scan", "error"])

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, ref, own in b[["call_key", "archive_ref", "scans"]].itertuples(index=False):
                error = next((x["error"] for x in own if x["error"]), None)
                if error:
                    rows.append((key, None, None, None, error))
                    continue
                there = [Scan(**(v | {"store": {int(k): t for k, t in v["store"].items()}})) for v in (json.loads(x["scan"]) for x in own)]
                n = sum(x.selected for x in there)
                if n:
                    first = next(f"{x.name}:{x.first}" for x in there if x.first)
                    try:
                        rows.append((key, n, first, rendered(ref, there, most_bytes, most_lines), None))
                    except Usage as e:
                        rows.append((key, n, first, None, str(e)))
            yield pd.DataFrame(rows, columns=["call_key", "matches", "first", "rendering", "error"])

    bound(found.sparkSession)
    each = found.mapInPandas(scans, "call_key string, archive_ref string, place int, scan string, error string")
    calls = each.groupBy("call_key", "archive_ref").agg(F.array_sort(F.collect_list(F.struct("place", "scan", "error"))).alias("scans"))
    return calls.mapInPandas(show, "call_key string, matches long, first string, rendering string, error string")


def read(found: DataFrame, arguments: Sequence[str]) -> DataFrame:
    """body, error of a range of one source, of sources as ``joint`` has them: a call with several sources needs one named."""
    from tallyloom.operators.archive import read_bytes, read_lines

    ref, source, unit, a, b = parse_read(arguments)
    bound(found.sparkSession)
    own = found.where(F.col("archive_ref") == ref)
    own = own.where(F.col("subject") == source) if source else own.withColumn("n", F.expr("count(*) over ()")).where("n = 1").drop("n")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for raw in x["body"]:
                try:
                    rows.append(((read_lines if unit == "lines" else read_bytes)(bytes(raw), a, b), None))
                except ValueError as e:
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["body", "error"])

    return own.select("body").mapInPandas(cut, "body binary, error string")
