"""What the reducers remove from the results of a corpus: one scan, one row of lengths and labels for each result.

The texts stay in their task: what leaves it are lengths, flags and labels, which reports group as they
like. A command is read once for each task and distinct command, then remembered.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.reduce import SETUP, TERMS, Policy, reduce_text
from tallyloom.operators.selection import choose

#: The reference, source and completeness that summaries of a report carry.
RECOVERY = ("yr_0123456789abcdef0123456789abcdef", "result_text", "unknown")
FAILURE_POINTS = 500
_LABELS = ("verdict", "rule", "reducer", "family", "kind", "suggested")
_LENGTHS = ("chars", "pruned_chars", "bytes", "pruned_bytes", "lines", "pruned_lines")
MEASURES = T.StructType(
    [T.StructField(n, T.StringType()) for n in _LABELS]
    + [T.StructField("syntax", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.LongType()) for n in _LENGTHS]
    + [T.StructField("changed", T.BooleanType()), T.StructField("marked", T.BooleanType()), T.StructField("lost_terms", T.ArrayType(T.StringType()))]
)
_choice = functools.lru_cache(100_000)(choose)


def _lines(raw: bytes) -> int:
    return raw.count(b"\n") + (raw[-1:] not in (b"", b"\n"))


def pruned(command: str, text: str, succeeded: bool | None) -> tuple[dict, bytes]:
    """(choice, what is left of the text) of one result. Texts with diagnostics of setup commands stay as they are."""
    found, raw = _choice(command), text.encode()
    if found["verdict"] != "reduce" or found["setup_text"] and SETUP.search(raw):
        return found, raw
    success = Policy(line=found["line_bytes"], least=found["least"])
    failure = Policy(line=found["failure_line_bytes"], least=found["least"], points=FAILURE_POINTS)
    known = succeeded if found["confidence"] == "complete" else None
    return found, reduce_text(found["reducer"].removesuffix("_summary"), raw, success, failure, known, RECOVERY, tuple(found["transforms"]))


def prune(results: DataFrame) -> DataFrame:
    """``results`` (command, output_text, succeeded and more) without the text, with ``MEASURES``; labels are null where there is no command."""
    kept = [c for c in results.columns if c not in ("output_text", "command")]
    schema = T.StructType([results.schema[c] for c in kept] + list(MEASURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for command, text, ok in zip(b.column("command").to_pylist(), b.column("output_text").to_pylist(), b.column("succeeded").to_pylist(), strict=True):
                raw = text.encode()
                found, out = ({}, raw) if command is None else pruned(command, text, ok)
                lost = [t for t, p in TERMS if p.search(raw) and not p.search(out)] if out != raw else []
                left = len(text) if out == raw else len(out.decode(errors="replace"))
                marked = f"search {RECOVERY[0]}".encode() in out
                lengths = (len(text), left, len(raw), len(out), _lines(raw), _lines(out))
                rows.append((*(found.get(n) for n in _LABELS), found.get("syntax"), *lengths, out != raw, marked, lost))
            columns = list(zip(*rows, strict=True)) or [[]] * len(MEASURES)
            made = [pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + made, names=kept + MEASURES.names)

    return results.where(F.col("output_text").isNotNull()).mapInArrow(run, schema)


_ARROW = [pa.string()] * len(_LABELS) + [pa.list_(pa.string())] + [pa.int64()] * len(_LENGTHS) + [pa.bool_(), pa.bool_(), pa.list_(pa.string())]
