"""Lines of a text that comes in chunks, in a constant number of bytes.

Whatever a line's length, its first and last ``limit`` bytes without escape sequences, its size and the diagnostic terms beyond
its beginning are kept, no more. The state of an escape sequence goes on from chunk to chunk and from line to line, so any cut of
a text gives the same lines. A line within the limit is plain bytes; a longer one (counted raw, with its line end) is a ``Long``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from tallyloom.functions.scalars import DIAGNOSTIC_TERMS

_GROUND, _ESCAPE, _CSI, _OSC, _OSC_ESCAPE = range(5)
_CSI_END, _OSC_END, _KEPT = re.compile(rb"[@-~]"), re.compile(rb"[\x07\x1b]"), re.compile(rb"[\r\n]")
_TERMS = [(t, t.encode()) for t in DIAGNOSTIC_TERMS]
_ANY = re.compile("|".join(map(re.escape, DIAGNOSTIC_TERMS)).encode())
#: Bytes before the limit from which on terms are looked for in the raw bytes: a term that crosses the limit is seen.
BEFORE = max(len(t) for t in DIAGNOSTIC_TERMS)


class Escapes:
    """Terminal escape sequences taken out of chunks; line breaks inside a sequence stay and don't end it."""

    __slots__ = ("state",)

    def __init__(self):
        self.state = _GROUND

    def push(self, chunk: bytes) -> bytes:
        if self.state == _GROUND and b"\x1b" not in chunk:
            return chunk
        out, i, n = [], 0, len(chunk)
        while i < n:
            if self.state == _GROUND:
                j = chunk.find(b"\x1b", i)
                if j < 0:
                    out.append(chunk[i:])
                    break
                out.append(chunk[i:j])
                self.state, i = _ESCAPE, j + 1
            elif self.state in (_ESCAPE, _OSC_ESCAPE):
                b = chunk[i : i + 1]
                i += 1
                if b in (b"\r", b"\n"):
                    out.append(b)
                elif self.state == _ESCAPE:
                    self.state = {b"[": _CSI, b"]": _OSC}.get(b, _GROUND)
                elif b != b"\x1b":
                    self.state = _GROUND if b == b"\\" else _OSC
            else:
                m = (_CSI_END if self.state == _CSI else _OSC_END).search(chunk, i)
                j = m.start() if m else n
                out += _KEPT.findall(chunk, i, j)
                if m:
                    self.state = _OSC_ESCAPE if m[0] == b"\x1b" else _GROUND
                i = j + 1
        return b"".join(out)


@dataclass(slots=True)
class Long:
    """A line beyond the limit: its beginning and end, how many bytes it has without escapes and line end, and the terms in its raw bytes from shortly before the limit on."""

    head: bytes
    tail: bytes
    size: int
    terms: frozenset[str]


def terms_in(low: bytes) -> set[str]:
    return {t for t, raw in _TERMS if raw in low} if _ANY.search(low) else set()


class Whole:
    """The lines of a text that is there as a whole."""

    def __init__(self, raw: bytes, limit: int):
        self.raw, self.limit, self.newline, self.count = raw, limit, b"\n", 0

    def __iter__(self) -> Iterator[bytes | Long]:
        raw, limit = self.raw, self.limit
        text = Escapes().push(raw)
        lines = text.split(b"\n")
        ended = lines[-1] == b"" and (raw.endswith(b"\n") or not raw)
        if ended:
            lines.pop()
        if lines and lines[0].endswith(b"\r") and b"\n" in text:
            self.newline = b"\r\n"
        long = len(raw) > limit and (len(text) < len(raw) or max(map(len, lines), default=0) >= limit)
        raws = raw.split(b"\n") if long else None
        for i, line in enumerate(lines):
            self.count += 1
            if raws is None or len(raws[i]) + (ended or i + 1 < len(lines)) <= limit:
                yield line.removesuffix(b"\r")
            else:
                body = line.removesuffix(b"\r")
                yield Long(body[:limit], body[-limit:], len(body), frozenset(terms_in(raws[i][max(0, limit - BEFORE) :].lower())))


class Chunked:
    """The lines of a text that comes in chunks."""

    def __init__(self, chunks: Iterable[bytes], limit: int):
        self.chunks, self.limit, self.newline, self.count = chunks, limit, b"\n", 0

    def __iter__(self) -> Iterator[bytes | Long]:
        limit, escapes = self.limit, Escapes()
        head, tail, size, raw, window, terms, ends = bytearray(), b"", 0, 0, b"", set(), False

        def take() -> bytes | Long:
            ending = ends and self.count == 1
            back = 1 if tail.endswith(b"\r") else 0
            if ending and back:
                self.newline = b"\r\n"
            if raw + ends <= limit:
                return bytes(head).removesuffix(b"\r")
            body = bytes(head) if size > limit else bytes(head).removesuffix(b"\r")
            last = tail[: len(tail) - back] if back else tail
            return Long(body[: min(limit, size - back)], last[-limit:], size - back, frozenset(terms))

        for chunk in self.chunks:
            for piece in _pieces(chunk):
                ends = piece.endswith(b"\n")
                body = piece[:-1] if ends else piece
                if raw + len(body) > limit - BEFORE:
                    begin = max(0, limit - BEFORE - raw)
                    low = window + body[begin:].lower()
                    terms |= terms_in(low)
                    window = low[-(BEFORE - 1) :]
                raw += len(body)
                shown = escapes.push(piece)
                shown = shown[:-1] if ends else shown
                size += len(shown)
                if len(head) < limit:
                    head += shown[: limit - len(head)]
                tail = shown[-limit - 1 :] if len(shown) > limit else (tail + shown)[-limit - 1 :]
                if ends:
                    self.count += 1
                    yield take()
                    head, tail, size, raw, window, terms, ends = bytearray(), b"", 0, 0, b"", set(), False
        if raw:
            self.count += 1
            yield take()


def _pieces(chunk: bytes) -> Iterator[bytes]:
    """A chunk cut after its line feeds."""
    a = 0
    while a < len(chunk):
        b = chunk.find(b"\n", a) + 1 or len(chunk)
        yield chunk[a:b]
        a = b
