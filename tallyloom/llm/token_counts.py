"""Token counts under a unigram vocabulary, without making the tokens.

A count-only Viterbi: Aho-Corasick enumerates every vocabulary piece that ends at each character of
a word; for each end the best score and the number of pieces on the best path are kept, nothing else.
Ties go as in the tokenizers library's unigram model: of equal scores the piece that starts first
(the longest) stays, scores add up from the left in doubles, a character without a piece of its own
costs the least score less 10, and neighbouring unknown characters count as one.

A text's words part at Unicode white space and get the mark ``▁`` in front, as that library's
WhitespaceSplit and Metaspace do; the count of a text is the sum over its words, so each distinct
word is worked out once and remembered (``CACHE`` words at most in a worker, none of them long).

No installed file is a unigram model: ``vocabulary`` takes the pieces of the 32k byte-pair file in
their order and scores rank r with -log(r + 2), Zipf's law; nothing is trained. Any list of
(piece, score) serves.

Edge cases: null and empty texts and texts of white space count 0; texts are read whole, and so are words
of any length; rows with null ids and repeated rows each get their count; an empty table gives no rows;
input columns with the result's names (in any case, as Spark compares them) are replaced.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a worker remembers, and the length of the longest.
CACHE, LONGEST = 500_000, 256
MARK, UNKNOWN_COST = "▁", 10.0
#: str.split parts at these, which Unicode does not count as white space.
_CONTROL = ("\x1c", "\x1d", "\x1e", "\x1f")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary pieces, scored by rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return [(p, -math.log(r + 2)) for r, p in enumerate(pieces)]


class Counter(dict):
    """Pieces of a marked word, by word."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for p, s in pieces:
            self.trie.add_word(p, (len(p), s))
        self.trie.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST

    def pieces(self, word: str) -> int:
        n = len(word)
        kinds = ("d", "l", "b") if n > LONGEST else None  # a long word's state is packed
        best, count, last_unknown = (array(k, [0]) * (n + 1) for k in kinds) if kinds else ([0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1))
        hits = self.trie.iter(word)
        end, hit = next(hits, (n, None))
        for e in range(n):
            found = []
            while end == e:
                found.append(hit)
                end, hit = next(hits, (n, None))
            top, c, u = None, 0, False
            single = False
            for length, s in sorted(found, reverse=True):  # the earliest start first
                x = best[e + 1 - length] + s
                single |= length == 1
                if top is None or x > top:
                    top, c, u = x, count[e + 1 - length] + 1, False
            if not single:
                x = best[e] + self.unknown
                if top is None or x > top:
                    top, c, u = x, count[e] + (not last_unknown[e]), True
            best[e + 1], count[e + 1], last_unknown[e + 1] = top, c, u
        return count[n]

    def __missing__(self, word: str) -> int:
        n = self.pieces(MARK + word.replace(" ", MARK))
        if len(word) <= LONGEST:
            if len(self) > CACHE:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        """Tokens and words of a text."""
        if not text:
            return 0, 0
        if any(c in text for c in _CONTROL):
            import re

            words = [w for w in re.split(r"[\t-\r \x85\xa0  -     　]+", text) if w]
        else:
            words = text.split()
        return sum(map(self.__getitem__, words)), len(words)


@functools.lru_cache(2)
def _counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(list(pieces))


@functools.lru_cache(2)
def _counter_of(path: str) -> Counter:
    return Counter(vocabulary(path))


def count(docs: DataFrame, path: str | None = None, pieces: list[tuple[str, float]] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and n_words, by the vocabulary at path or the pieces given."""
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "n_words")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_words")])
    fixed = tuple(pieces) if pieces is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter_of(path) if fixed is None else _counter(fixed)
        for b in batches:
            rows = [counter.count(t) for t in b.column(text).to_pylist()]
            made = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + made, names=kept + ["n_tokens", "n_words"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
