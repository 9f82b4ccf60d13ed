"""Data source ``part_files``: content parts kept as one file each.

Reading lists and hashes the files in the tasks. Each task owns the names with one remainder of
a checksum, so a flat folder of any size is spread evenly, files without bytes included, and no
listing passes through the driver. A filter on part ids is answered without listing: the tasks
open just those files. Bytes are read in pieces and never leave the task; the file's time and
length are its version, so ``verified_for`` reads a changed file again.

Writing puts each row's bytes under its part id, in one step per file. A task that is repeated
writes the same files again, so an aborted attempt leaves nothing wrong behind.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from vaultferry.sources.files import listing, put, store_of

SCHEMA = "part_id string, sha256 string, blob_bytes bigint, version string"
ENDING = ".bin"
# Tasks that share a folder, unless the option ``partitions`` says otherwise.
PARTITIONS = 64
PIECE = 1 << 20
# A part id is part of a path: no separators, no names that mean another folder.
SAFE_ID = re.compile(r"(?!\.)[^/\\\x00]+")


@dataclass
class Share(InputPartition):
    """Names with one checksum remainder, or the names asked for."""

    number: int
    names: tuple[str, ...] | None = None


def remainder(name: str, partitions: int) -> int:
    return zlib.crc32(name.encode()) % partitions


class PartFileReader(DataSourceReader):
    def __init__(self, path: str, partitions: int):
        self.path, self.count = path, partitions
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over filters that name part ids; others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("part_id",):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == ("part_id",):
                names = set(f.value)
            else:
                yield f
                continue
            names.discard(None)
            self.asked = names if self.asked is None else self.asked & names

    def partitions(self) -> list[Share]:
        if self.asked is None:
            return [Share(n) for n in range(self.count)]
        shares: dict[int, list[str]] = {}
        for name in sorted(self.asked):
            shares.setdefault(remainder(name, self.count), []).append(name)
        return [Share(n, tuple(names)) for n, names in sorted(shares.items())]

    def read(self, partition: Share) -> Iterator[tuple]:
        store, root = store_of(self.path)
        for info in self._files(store, root, partition):
            digest = hashlib.sha256()
            with store.open_input_stream(info.path) as source:
                while piece := source.read(PIECE):
                    digest.update(piece)
            name = info.base_name.removesuffix(ENDING)
            yield name, digest.hexdigest(), info.size, f"{info.mtime_ns}-{info.size}"

    def _files(self, store: fs.FileSystem, root: str, share: Share) -> Iterator[fs.FileInfo]:
        if share.names is not None:
            wanted = [f"{root}/{n}{ENDING}" for n in share.names if SAFE_ID.fullmatch(n)]
            if wanted:
                yield from (i for i in store.get_file_info(wanted) if i.type == fs.FileType.File)
            return
        for info in listing(store, root):
            name = info.base_name
            if name.startswith(".") or not name.endswith(ENDING):
                continue
            if remainder(name.removesuffix(ENDING), self.count) == share.number:
                yield info


class PartFileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        store, root = store_of(self.path)
        for row in rows:
            if not SAFE_ID.fullmatch(row["part_id"] or ""):
                raise ValueError(f"{row['part_id']!r} cannot be the name of a file")
            put(store, f"{root}/{row['part_id']}{ENDING}", bytes(row["content"] or b""))
        return WriterCommitMessage()


class PartFiles(DataSource):
    """``spark.read.format("part_files").load(folder)``; writes (part_id, content) rows."""

    @classmethod
    def name(cls) -> str:
        return "part_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PartFileReader:
        count = int(self.options.get("partitions", PARTITIONS))
        return PartFileReader(self.options["path"], count)

    def writer(self, schema: T.StructType, overwrite: bool) -> PartFileWriter:
        if overwrite:
            raise ValueError("part files are added one by one; write with mode append")
        return PartFileWriter(self.options["path"])


def register_part_files(spark: SparkSession) -> None:
    """Make the source known to a session; filters on part ids then reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PartFiles)
