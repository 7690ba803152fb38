"""A data source of line-delimited logs that grow: read by byte ranges once, and followed by byte offsets.

``spark.read.format("appended_lines")`` gives the terminated lines below ``path`` with their offsets; a file of any size is
as many tasks as it has ranges of ``range_bytes``. A line belongs to the range that it begins in, so a task reads on
past its range to its last line's end, and nothing is read twice. ``spark.readStream`` goes on where it was: its
offset holds, for every file, how far complete lines were read and a digest of the ``PROBE`` bytes before that place.
A file that shrank, or has other bytes there, starts again, after a row of kind ``checkpoint_reset`` that says why; a file
that goes is forgotten. A last line without its line feed waits. Every line carries its file's first one (``head``), as
formats say there whose session it is.

Files are opened by the Arrow file systems (local paths, ``hdfs://``, ``s3://`` and the like). The driver lists the files and, in a
stream, reads their last line's beginning; contents are read by tasks.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "appended_lines"
SCHEMA = "path string, byte_offset long, end long, raw binary, head binary, kind string"
#: Bytes of a range, of a piece that is read at a time, and before an offset that are to be the same when a stream goes on.
RANGE, PIECE, PROBE = 64 << 20, 1 << 20, 64 << 10
_ARROW = pa.schema([("path", pa.string()), ("byte_offset", pa.int64()), ("end", pa.int64()), ("raw", pa.binary()), ("head", pa.binary()), ("kind", pa.string())])


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``stop``; reset: why a stream reads the file from its start again."""

    path: str
    start: int
    stop: int
    end: int
    reset: str | None = None


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root and not root.startswith("file://"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file://")


def listed(root: str, glob: str) -> dict[str, int]:
    """path and size of the files below a folder whose names fit."""
    system, base = _opened(root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.is_file and fnmatch.fnmatch(f.base_name, glob)}


def last_end(file, size: int, start: int = 0) -> int:
    """Where the last terminated line ends, looked for from the end of the file."""
    at = size
    while at > start:
        begin = max(start, at - PIECE)
        file.seek(begin)
        k = file.read(at - begin).rfind(b"\n")
        if k >= 0:
            return begin + k + 1
        at = begin
    return start


def lines_of(file, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin from start on and before stop, in a file whose lines end at ``end``. Read in pieces, once."""
    at, rest, inside = max(0, start - 1), b"", start == 0
    file.seek(at)
    begin = 0 if inside else None
    while at < end and (begin is None or begin < stop):
        piece = file.read(min(PIECE, end - at))
        if not piece:
            break
        at += len(piece)
        rest += piece
        if begin is None:  # a line that begins at start follows a line feed just before it
            k = rest.find(b"\n")
            if k < 0:
                rest = b""
                continue
            begin, rest = at - len(rest) + k + 1, rest[k + 1 :]
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if begin >= stop:
                return
            yield begin, line
            begin += len(line) + 1


def _ranges(path: str, start: int, end: int, width: int, reset: str | None = None) -> list[Range]:
    return [Range(path, a, min(a + width, end), end, reset if a == start else None) for a in range(start, end, width)]


class _Reading:
    """What both readers do in tasks."""

    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.width = int(options.get("range_bytes", RANGE))

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.root)
        with system.open_input_file(part.path) as file:
            head = next((line for _, line in lines_of(file, 0, 1, part.end)), None)
            rows, size = [], 0
            if part.reset:
                rows.append((part.path, 0, 0, part.reset.encode(), head, "checkpoint_reset"))
            for offset, line in lines_of(file, part.start, part.stop, part.end):
                rows.append((part.path, offset, offset + len(line) + 1, line, head, "line"))
                size += len(line) + len(head or b"")
                if size > PIECE:
                    yield self._batch(rows)
                    rows, size = [], 0
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        system, _ = _opened(self.root)
        out = []
        for path, size in sorted(listed(self.root, self.glob).items()):
            with system.open_input_file(path) as file:
                out += _ranges(path, 0, last_end(file, size), self.width)
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from super().read(part) if part.path else iter([self._batch([])])


class StreamReader(_Reading, DataSourceStreamReader):
    """Offsets: {path: [end of the lines read, digest of the bytes before it]}."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        system, _ = _opened(self.root)
        now = {}
        for path, size in sorted(listed(self.root, self.glob).items()):
            with system.open_input_file(path) as file:
                end = last_end(file, size)
                now[path] = [end, _probe(file, end)]
        return {"files": json.dumps(now)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        system, _ = _opened(self.root)
        known, now, out = json.loads(start["files"]), json.loads(end["files"]), []
        for path, (to, _digest) in now.items():
            was, digest = known.get(path, (0, None))
            why = None
            if was:
                if to < was:
                    why = f"the lines end at {to}, before {was}"
                else:
                    with system.open_input_file(path) as file:
                        why = None if _probe(file, was) == digest else f"the bytes before {was} are others"
            out += _ranges(path, 0 if why else was, to, self.width, why)
        return out


def _probe(file, end: int) -> str:
    begin = max(0, end - PROBE)
    file.seek(begin)
    return hashlib.sha256(file.read(end - begin)).hexdigest()


class AppendedLines(DataSource):
    """The source; options: path, glob (``*.jsonl``), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)
