"""Data source ``outbox``: messages delivered to a folder in two steps, by batch or stream.

Each task writes its messages to a file of its own and reports name, rows, bytes and digest.
Only when all tasks have succeeded does the driver write the manifest of the batch, in one step;
readers open the files that manifests list and no others. So the file of a task that failed,
was repeated or ran twice is never read, and a batch written again replaces its manifest.

The option ``batch`` names a batch. A streaming query's batches are named by the option
``stream`` and their number; the same name must not be given to two queries.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    InputPartition,
    WriterCommitMessage,
)

from vaultferry.sources.files import get, listing, put, store_of

SCHEMA = "batch string, archive_class string, message string"
DATA, MANIFESTS = "data", "manifests"
# Messages are written and read in runs of about so many bytes; a single one may be longer.
RUN_BYTES = 1 << 20
line_of = json.JSONEncoder(ensure_ascii=False).encode


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote; ``file`` is empty where it had no rows."""

    file: str
    rows: int
    bytes: int
    sha256: str


@dataclass
class Listed(InputPartition):
    batch: str
    file: str
    sha256: str


def write_rows(path: str, rows: Iterator[T.Row]) -> Written:
    return write_messages(path, ((r["archive_class"], r["message"]) for r in rows))


def write_record_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    columns = (tuple(b.column(c) for c in ("archive_class", "message")) for b in batches)
    return write_messages(path, (m for k, t in columns for m in zip(k.to_pylist(), t.to_pylist())))


def runs_of(lines: Iterator) -> Iterator[list]:
    """Lines in runs of about ``RUN_BYTES``."""
    run, size = [], 0
    for line in lines:
        run.append(line)
        size += len(line)
        if size >= RUN_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def write_messages(path: str, messages: Iterator[tuple]) -> Written:
    """Write a task's messages (archive class, text) to a new file, one a line."""
    store, root = store_of(path)
    folder, name = f"{root}/{DATA}", f"{uuid.uuid4().hex}.jsonl"
    digest, count, size, out = hashlib.sha256(), 0, 0, None
    for run in runs_of(line_of(m) + "\n" for m in messages):
        if out is None:
            store.create_dir(folder, recursive=True)
            out = store.open_output_stream(f"{folder}/{name}")
        raw = "".join(run).encode()
        out.write(raw)
        digest.update(raw)
        count, size = count + len(run), size + len(raw)
    if out is None:
        return Written("", 0, 0, "")
    out.close()
    return Written(name, count, size, digest.hexdigest())


def write_manifest(path: str, batch: str, messages: list) -> None:
    store, root = store_of(path)
    files = [asdict(m) for m in messages if m is not None and m.file]
    body = json.dumps({"batch": batch, "files": files}, sort_keys=True)
    name = hashlib.sha256(batch.encode()).hexdigest()
    put(store, f"{root}/{MANIFESTS}/{name}.json", body.encode())


def drop_files(path: str, messages: list) -> None:
    """Remove what the tasks of a failed batch reported; other files are just never listed."""
    store, root = store_of(path)
    for m in messages:
        if m is not None and m.file:
            store.delete_file(f"{root}/{DATA}/{m.file}")


class OutboxWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return write_record_batches(self.path, batches)

    def commit(self, messages: list) -> None:
        write_manifest(self.path, self.batch, messages)

    def abort(self, messages: list) -> None:
        drop_files(self.path, messages)


class OutboxStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, stream: str):
        self.path, self.stream = path, stream

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return write_record_batches(self.path, batches)

    def commit(self, messages: list, batchId: int) -> None:
        write_manifest(self.path, f"{self.stream}-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        drop_files(self.path, messages)


class OutboxReader(DataSourceReader):
    """One task per listed file; a file that does not fit its digest is an error."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Listed]:
        store, root = store_of(self.path)
        found = []
        for info in listing(store, f"{root}/{MANIFESTS}"):
            if info.base_name.startswith("."):
                continue
            manifest = json.loads(get(store, info.path))
            found += [Listed(manifest["batch"], f["file"], f["sha256"]) for f in manifest["files"]]
        return found or [Listed("", "", "")]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, root = store_of(self.path)
        digest = hashlib.sha256()
        with store.open_input_stream(f"{root}/{DATA}/{partition.file}") as source:
            for run in runs_of(io.BufferedReader(source)):
                digest.update(b"".join(run))
                classes, texts = zip(*json.loads(b"[" + b",".join(run) + b"]"))
                columns = ([partition.batch] * len(run), classes, texts)
                arrays = [pa.array(c, pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, ["batch", "archive_class", "message"])
        if digest.hexdigest() != partition.sha256:
            raise ValueError(f"{partition.file} is not what its manifest says")


class Outbox(DataSource):
    """``messages.write.format("outbox").option("batch", ...)``; rows of ``outbox_rows``."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> OutboxReader:
        return OutboxReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> OutboxWriter:
        if overwrite:
            raise ValueError("batches are added or replaced by name; write with mode append")
        return OutboxWriter(self.options["path"], self.options["batch"])

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> OutboxStreamWriter:
        return OutboxStreamWriter(self.options["path"], self.options["stream"])


def register_outbox(spark: SparkSession) -> None:
    spark.dataSource.register(Outbox)
