"""Data source ``identity_map``: one large JSON identity document, read by many tasks.

The document is ``{"mappings": [{"upn": ..., "targetArchiveId": ...}, ...]}``. It is cut into
byte ranges. An entry that begins with one of its two names can be recognised anywhere in the
text, as a quote inside a string is written with a backslash (objects inside an entry must not
begin with these names, nor any after the list; the format has none). A task starts at the first such
entry of its range and goes on, entry by entry, to the first such entry of a later range. So each
entry is read by one task, whatever stands in it. ``pos`` is the entry's offset, which keeps the
order of the file: the last entry of an owner wins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vaultferry.sources.files import store_of

SCHEMA = "upn string, target_archive string, pos bigint"
RANGE_BYTES = 16 << 20
# Ranges below RANGE_BYTES that a file is cut into at most.
SMALL_RANGES = 256
PIECE = 1 << 20
ENTRY = re.compile(rb'\{\s*"(?:upn|targetArchiveId)"\s*:')
# The longest text before the colon of an entry's first name that is looked for.
LOOK_BACK = 4096
GAP = re.compile(rb"[ \t\r\n,]*")
MARK = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
LIST = re.compile(rb'"mappings"\s*:\s*(\[|null)')


@dataclass
class Span(InputPartition):
    start: int
    end: int


class Window:
    """A growing piece of the file, read from a position on; ``here`` is the place reached in it."""

    def __init__(self, source, at: int, piece: int = PIECE):
        self.source, self.start, self.piece = source, at, piece
        self.data, self.here, self.whole = b"", 0, False
        source.seek(at)

    @property
    def at(self) -> int:
        return self.start + self.here

    @property
    def left(self) -> int:
        return len(self.data) - self.here

    def grow(self) -> bool:
        """Read on, as much again as is left, so that a long entry is copied few times."""
        piece = self.source.read(max(self.piece, self.left))
        self.start, self.data, self.here = self.at, self.data[self.here :] + piece, 0
        self.whole |= not piece
        return bool(piece)


def end_of_object(data: bytes, start: int = 0) -> int:
    """Length of the object that begins at ``start``; 0 if it is not complete."""
    depth, inside = 0, False
    for m in MARK.finditer(data, start):
        mark = m[0]
        if mark == b'"':
            inside = not inside
        elif not inside and mark in b"{[":
            depth += 1
        elif not inside and mark in b"}]":
            depth -= 1
            if depth == 0:
                return m.end() - start
    return 0


class IdentityReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Span]:
        store, path = store_of(self.path)
        length = store.get_file_info(path).size or 0
        # A task starts a Python worker and opens the file: a long file has no tiny ranges.
        size = max(self.size, min(RANGE_BYTES, -(-length // SMALL_RANGES)))
        return [Span(n, min(n + size, length)) for n in range(0, length, size)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        store, path = store_of(self.path)
        with store.open_input_file(path) as source:
            piece = min(PIECE, partition.end - partition.start + 2 * LOOK_BACK)
            window = Window(source, partition.start, piece)
            first = self._list_start(window) if partition.start == 0 else self._entry(window, partition)
            if first is None:
                return
            window.here = first
            yield from self._entries(window, partition)

    def _list_start(self, window: Window) -> int | None:
        """Where the entries begin; the document's first task starts there, whatever comes."""
        while not (m := LIST.search(window.data)):
            if not window.grow():
                return None
        return None if m[1] == b"null" else m.end()

    def _entry(self, window: Window, span: Span) -> int | None:
        """Start of the first recognisable entry of the range."""
        while not (m := ENTRY.search(window.data, window.here)):
            window.here = max(window.here, len(window.data) - LOOK_BACK)
            if window.at >= span.end or not window.grow():
                return None
        return m.start() if window.start + m.start() < span.end else None

    def _entries(self, window: Window, span: Span) -> Iterator[tuple]:
        while True:
            window.here = GAP.match(window.data, window.here).end()
            if window.left < LOOK_BACK and not window.whole:
                window.grow()
                continue
            if not window.left or window.data.startswith(b"]", window.here):
                return
            if window.at >= span.end and ENTRY.match(window.data, window.here):
                return
            while not (size := end_of_object(window.data, window.here)):
                if not window.grow():
                    raise ValueError(f"the entry at byte {window.at} does not end")
            entry = json.loads(window.data[window.here : window.here + size])
            yield entry.get("upn"), entry.get("targetArchiveId"), window.at
            window.here += size


class IdentityMap(DataSource):
    """``spark.read.format("identity_map").load(file)``; option ``rangeBytes`` sizes the tasks.

    A file has at most ``SMALL_RANGES`` tasks below ``RANGE_BYTES``, whatever the option says.
    """

    @classmethod
    def name(cls) -> str:
        return "identity_map"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> IdentityReader:
        size = int(self.options.get("rangeBytes", RANGE_BYTES))
        return IdentityReader(self.options["path"], size)


def register_identity_map(spark: SparkSession) -> None:
    spark.dataSource.register(IdentityMap)
