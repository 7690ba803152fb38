"""Words and their hashes, many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np

#: The bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some texts. hashes: one 64-bit value for each word; first: where each text's words begin
    (one more than texts); starts and ends: the words' bytes in data."""

    def __init__(self, texts: list[bytes], lower: bool, apart: np.ndarray = SPACE):
        data = b"\n".join(texts) + b"\n"
        self.data = data.translate(LOWER_ASCII) if lower else data
        a = np.frombuffer(self.data, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(apart[a].view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        at = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, at)
        self.hashes = self._hash()

    def prefixes(self, k: int) -> np.ndarray:
        """A value of each word's first k bytes (k up to 8; words of fewer or as many bytes: 0)."""
        padded = self.data + b"\0" * 8
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        return np.where(self.ends - self.starts > k, mix((eight[self.starts] & _MASKS[k]) + np.uint64(k * int(_C1) % 2**64)), np.uint64(0))

    def _hash(self) -> np.ndarray:
        n = len(self.starts)
        lens = self.ends - self.starts
        h = lens.astype(np.uint64) * _C1
        if not n:
            return h
        padded = self.data + b"\0" * 8
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        at, left, who = self.starts, lens, None
        while len(at):
            v = eight[at] & _MASKS[np.minimum(left, 8)]
            if who is None:
                h = mix(h ^ v)
            else:
                h[who] = mix(h[who] * _C1 ^ v)
            more = np.flatnonzero(left > 8)
            who = more if who is None else who[more]
            at, left = at[more] + 8, left[more] - 8
        return h


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors, the same everywhere."""
    x = mix(np.arange(1, n + 1, dtype=np.uint64) * _C1 + np.uint64(seed))
    return x | np.uint64(1)


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words of the array (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factors, out = odd_constants(k, k), np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += words[j : j + n] * factors[j]
    return mix(out)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = 500_000):
    """Slices (from, to) of about ``most`` bytes, each at least one text."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)
