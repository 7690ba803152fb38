"""A data source of SQLite files: rows by ranges of their rowid, so that a store of any size is read by many tasks, one row at a time.

``spark.read.format("sqlite_rows").option("table", ...).schema(...)``: below ``path``, of every file whose name fits ``glob``, the columns of the
schema but ``path`` and ``row``, which are the file's and the row's. Files are opened read-only (without a lock, as immutable, where the option
says so), at local paths: SQLite reads no others. Files without the table have no rows; so have files that are no databases,
unless ``strict`` is set.
"""

from __future__ import annotations

import contextlib
import fnmatch
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "sqlite_rows"
#: Rows of a range.
ROWS = 50_000


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.columns, self.table = [c for c in columns if c not in ("path", "row")], options["table"]
        self.order, self.root, self.glob, self.width = columns, options["path"].removeprefix("file://").removeprefix("file:"), options.get("glob", "*.db"), int(options.get("rows", ROWS))
        self.mode = "mode=ro&immutable=1" if options.get("immutable", "false") == "true" else "mode=ro"
        self.strict = options.get("strict", "false") == "true"

    def _open(self, path: str):
        return contextlib.closing(sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?{self.mode}", uri=True))

    def _files(self) -> Iterator[str]:
        if os.path.isfile(self.root):
            yield self.root
        for folder, _, names in os.walk(self.root):
            yield from (f"{folder}/{n}" for n in names if fnmatch.fnmatch(n, self.glob))

    def partitions(self) -> list[Rows]:
        out = []
        for path in sorted(self._files()):
            try:
                with self._open(path) as db:
                    if not db.execute("select 1 from sqlite_master where type = 'table' and name = ?", (self.table,)).fetchone():
                        continue
                    first, last = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
            except sqlite3.DatabaseError:
                if self.strict:
                    raise
                continue
            if first is not None:
                out += [Rows(path, a, min(a + self.width - 1, last)) for a in range(first, last + 1, self.width)]
        return out or [Rows("", 0, -1)]

    def read(self, part: Rows) -> Iterator[tuple]:
        if not part.path:
            return
        with self._open(part.path) as db:
            names = ", ".join(map(_quoted, self.columns))
            for row in db.execute(f"select rowid{', ' + names if names else ''} from {_quoted(self.table)} where rowid between ? and ?", (part.first, part.last)):
                values = dict(zip(self.columns, row[1:], strict=True)) | {"path": part.path, "row": row[0]}
                yield tuple(values[c] for c in self.order)


class SqliteRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the schema: path string, row long, and the table's columns")

    def reader(self, schema) -> Reader:
        return Reader(self.options, [f.name for f in schema.fields])
