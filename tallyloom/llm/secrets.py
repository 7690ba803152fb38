"""Secrets: fixed patterns, and literals that code or configuration assigns to sensitive names.

Base kinds, each leftmost and non-overlapping: ``assign`` (a sensitive word, ``:`` or ``=``, a value
of 6 characters or more; its span is the whole match), ``access`` (AKIA and on, 20 characters or
more) and ``hex`` (24 or more lower-case hex digits). Matches that fail the length are dropped and
not retried.

The method adds kind ``named``: each line, with those that an open assignment runs on to, is lexed into
tokens (names, string literals, bare words, numbers, punctuation); assignments ``name = value`` in the forms
of source code, shell, YAML, INI and JSON become name-literal pairs, so do ``name: type = literal`` and
``name["key"] = value`` (a pair of the key). A value on a later line than its operator is a string, a constant
or the only word of its line. A value is a concatenation of literals and names; names stand for the constants
assigned to them earlier in the text, so a key put together from parts is seen whole, and the span
is that of the literals on the assigning line. A pair is a finding if its name's parts are sensitive
and the literal scores at least ``THRESHOLD``: the name's weight times the literal's likeness to a
key (length, character classes, entropy). Whole literals that a base span covers aren't repeated.

Edge cases: null and empty texts have no spans; texts are read whole, in time linear in their
length and in memory that doesn't grow with what constants stand for (a constant is kept, and scored once, as the
counts of its characters); those of more than ``LONGEST`` characters are not propagated; offsets are code points, ends
exclusive; rows with null ids and repeated rows each get theirs; an empty table gives no rows; input
columns with the result's names (in any case, as Spark compares them) are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm._shared import tidied

KINDS = ("assign", "access", "hex")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# Weights of name parts; other parts weigh nothing.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "private": 0.7, "signing": 0.7, "bearer": 0.8, "access": 0.6, "key": 0.7, "salt": 0.5, "webhook": 0.6,
}
THRESHOLD = 0.5
_STRINGS = {'"': r'''"(?:[^"\\\n]|\\.)*"''', "'": r"""'(?:[^'\\\n]|\\.)*'"""}
_OTHERS = (
    r"""(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)|(?P<bare>[0-9][A-Za-z0-9_+/.=-]*)|(?P<op>:=|=>|==|!=|<=|>=|[:=+(){},;\[\]])|(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<other>.)"""
)
#: By the quotes that may still open a string.
_TOKENS = {q: re.compile((f"(?P<string>{'|'.join(_STRINGS[c] for c in q)})|" if q else "") + _OTHERS) for q in ("\"'", '"', "'", "")}
#: Longer constants stand for nothing: no key is so long, and constants made of constants can't grow without bound.
LONGEST = 4096
#: Characters in which a path or a placeholder is told from a key.
HEAD = 8
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_ASSIGNS = frozenset((":=", "=>", "=", ":"))
_QUICK = re.compile(r"[:=]")


def name_weight(name: str) -> float:
    """How sensitive a name is: the most of its parts (snake, kebab, camel or dotted)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = ["".join(x) for x in zip(parts, parts[1:], strict=False)]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


class _Literal:
    """What the score needs of a literal: its first characters, its length, how often it has each character."""

    __slots__ = ("counts", "head", "n", "score")

    def __init__(self, head: str, n: int, counts: dict[str, int]):
        self.head, self.n, self.counts, self.score = head, n, counts, _likeness(head, n, counts)


def _likeness(head: str, n: int, counts: dict[str, int]) -> float:
    if n < 8 or len(counts) <= 3 or head.startswith(("http://", "https://", "/", "./", "${", "<", "{{", "%")) or any(c.isspace() for c in counts):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    classes = sum((any(c.islower() for c in counts), any(c.isupper() for c in counts), any(c.isdigit() for c in counts), any(not c.isalnum() for c in counts)))
    return min(1.0, entropy / 3.5) * (0.4 + 0.3 * min(classes - 1, 2)) * min(1.0, n / 12)


def _together(parts: list[str | _Literal]) -> _Literal:
    """The literal that the parts make, none of which is copied; one that is a constant by itself is that constant."""
    if len(parts) == 1 and isinstance(parts[0], _Literal):
        return parts[0]
    head, n, counts = "", 0, Counter()
    for p in parts:
        if len(head) < HEAD:
            head += (p if isinstance(p, str) else p.head)[: HEAD - len(head)]
        n += len(p) if isinstance(p, str) else p.n
        counts.update(p if isinstance(p, str) else p.counts)
    return _Literal(head, n, counts)


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a key rather than a word, a path or a placeholder."""
    return _together([value]).score


def _lex(line: str, at: int) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, row) of the tokens. A quote that its row doesn't close is a sign like others, and so are
    the row's further ones of its kind, none of which is closed either: no character is looked at again for each."""
    tokens, row, pos, quotes = [], 0, 0, "\"'"
    while pos < len(line):
        for m in _TOKENS[quotes].finditer(line, pos):
            kind, pos = m.lastgroup, m.end()
            if kind == "line":
                row += 1
                if len(quotes) < 2:
                    quotes = "\"'"
                    break
            elif kind != "space":
                tokens.append((kind, m.group(), at + m.start(), at + pos, row))
                if kind == "other" and m.group() in quotes:
                    quotes = quotes.replace(m.group(), "")
                    break
    return tokens


def _typed(tokens: list, j: int) -> int | None:
    """Where the value of ``type = value`` begins, if that is what stands at j."""
    depth, row = 0, tokens[j - 1][4]
    for k in range(j, len(tokens)):
        kind, t = tokens[k][:2]
        if t in _ASSIGNS:
            return k + 1 if t == "=" and k > j and not depth else None
        if tokens[k][4] > row and not depth:
            return None
        if t in ("[", "(", "<", "{"):
            depth += 1
        elif t in ("]", ")", ">", "}"):
            depth -= 1
        elif not depth and kind not in ("name", "string") and t not in ("|", "&", "?", "*", ".", "'"):
            return None
        if depth < 0:
            return None
    return None


def _value(tokens: list, j: int, line: str, at: int, constants: dict[str, _Literal]) -> tuple[list[str | _Literal], int | None, int | None, bool, int]:
    """(parts, start, end, whether a literal or constant is among them, next token) of the value that begins at j."""
    value, start, end, literal, inside = [], None, None, False, False
    none, row, n = (value, None, None, False, j), tokens[j - 1][4], len(tokens)
    is_key = lambda i: i + 1 < n and tokens[i + 1][1] in _ASSIGNS
    part = lambda i: tokens[i][0] == "string" or tokens[i][0] == "name" and tokens[i][1] in constants

    def run(i: int) -> int:  # bare values run on to white space
        e = i + 1
        while e < n and tokens[e][2] == tokens[e - 1][3] and tokens[e][0] in ("name", "bare", "other"):
            e += 1
        return e

    i = j
    while i < n and tokens[i][1] in ("(", "\\", "+", "-", "|", ">"):
        inside |= tokens[i][1] == "("
        i += 1
    if i >= n or tokens[i][4] > row and is_key(i):
        return none
    if (i > j or tokens[i][4] > row) and not part(i):
        if tokens[i][4] == row or tokens[i][0] not in ("name", "bare"):
            return none
        e = run(i)
        if e < n and tokens[e][4] == tokens[i][4]:
            return none
    j = i
    while j < n:
        k, t, a, b, row = tokens[j]
        if k == "string":
            value.append(t[1:-1])
            start, end, literal = (a + 1 if start is None else start), b - 1, True
        elif k == "bare" or k == "name" and t not in constants:
            e = run(j)
            b = tokens[e - 1][3]
            value.append(line[a - at : b - at])
            start, end, j = (a if start is None else start), b, e - 1
        elif k == "name":
            value.append(constants[t])
            start, end, literal = (a if start is None else start), b, True
        else:
            break
        j += 1
        i = j
        while i < n and tokens[i][1] in ("+", "\\"):
            i += 1
        plus = any(x[1] == "+" for x in tokens[j:i])
        if i >= n or tokens[i][4] > row and (is_key(i) or not part(i)):
            break
        if plus or k == tokens[i][0] == "string" and (inside or i > j or tokens[i][4] == row) and not is_key(i):
            j = i
            continue
        break
    return value, start, end, literal, j


def _pairs(line: str, at: int, constants: dict[str, _Literal]) -> Iterator[tuple[str, _Literal, int, int]]:
    """(name, value, start, end) of the line's assignments; remembers constants."""
    tokens = _lex(line, at)
    i = 0
    while i < len(tokens) - 2:
        kind, text = tokens[i][:2]
        if kind not in ("name", "string"):
            i += 1
            continue
        op, key = i + 1, kind == "string" and i > 0 and tokens[i - 1][1] == "[" and tokens[i + 1][1] == "]"
        if key or tokens[op][1] in ("?", "!") and tokens[op + 1][1] == ":":
            op += 1
        if tokens[op][1] not in _ASSIGNS or op + 1 >= len(tokens):
            i += 1
            continue
        names = [text[1:-1] if kind == "string" else text]
        first = _typed(tokens, op + 1) if tokens[op][1] == ":" else None
        got = first and first < len(tokens) and _value(tokens, first, line, at, constants)
        if got and got[3]:
            if tokens[first - 2][0] == "name":
                names.append(tokens[first - 2][1])  # "see: token = literal"
        else:
            got = _value(tokens, op + 1, line, at, constants)
        value, start, end, literal, j = got
        if value:
            whole = _together(value)
            for name in names:
                if (literal or len(value) == 1) and not key:
                    if whole.n <= LONGEST:
                        constants[name] = whole
                    else:
                        constants.pop(name, None)
                yield name, whole, start, end
        i = max(j, op + 1)


_LEADING_PLUS = re.compile(r"""[ \t]+\+[ \t]*["']""")


def _logical(text: str) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines with assignments, each with the lines that its open value runs on to."""
    lines, k, at = text.split("\n"), 0, 0
    while k < len(lines):
        a, line = k, lines[k]
        k += 1
        if "=" in line or ":" in line:
            last, inside = line, False
            while k < len(lines):
                if lines[k].strip():
                    s = last.rstrip()
                    head = s.rstrip("(\\|>+- \t")
                    opened = head.endswith((":", "="))
                    inside |= opened and s.endswith("(")
                    quoted = lines[k].lstrip()[0] in "\"'"
                    if not (opened or s.endswith(("+", "\\")) or inside and quoted or s[-1] in "\"'" and _LEADING_PLUS.match(lines[k])):
                        break
                    last = lines[k]
                k += 1
            line = "\n".join(lines[a:k])
            yield at, line
        at += len(line) + 1


def named(text: str) -> list[tuple[int, int]]:
    """Spans of literals assigned to sensitive names."""
    found, constants = [], {}
    if not _QUICK.search(text):
        return found
    for at, line in _logical(text):
        for name, value, s, e in _pairs(line, at, constants):
            w = name_weight(name)
            if w and w * value.score >= THRESHOLD:
                found.append((s, e))
    return sorted(set(found))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        for m in _ASSIGN.finditer(text):
            if len(m.group(2)) >= 6:
                found.append((m.start(), m.end(), "assign"))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                found.append((m.start(), m.end(), "access"))
    for m in _HEX.finditer(text):
        found.append((m.start(), m.end(), "hex"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(text: str | None) -> tuple[list, list]:
    """Base spans, and all spans with the method's."""
    if not text:
        return [], []
    base = base_spans(text)
    added, k, reach = [], 0, -1
    for s, e in named(text):
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][1])
            k += 1
        if e > reach:
            added.append((s, e, "named"))
    return base, sorted(base + added, key=lambda x: (x[0], (*KINDS, "named").index(x[2]))) if added else base


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SCHEMA = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "redacted")]
)


def redact(text: str | None, spans: list) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = e
    return "".join(out) + text[at:]


def find(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256, spans (and the redacted text).

    Columns of the input with these names are replaced.
    """
    made = [n for n in SCHEMA.names if redacted or n != "redacted"]
    kept = [c for c in docs.columns if c.lower() not in made]
    schema = T.StructType([docs.schema[c] for c in kept] + [SCHEMA[n] for n in made])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(text).to_pylist()
                rows = [scan(t) for t in texts]
                columns = [pa.array([sum(x[2] == k for x in base) for base, _ in rows], pa.int64()) for k in KINDS]
                columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()))
                columns.append(pa.array([joined(all_) for _, all_ in rows], pa.string()))
                if redacted:
                    columns.append(pa.array([redact(t, all_) for t, (_, all_) in zip(texts, rows, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + columns, names=kept + made)

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
