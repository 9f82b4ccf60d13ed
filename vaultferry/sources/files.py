"""Files that tasks of a data source read and write by themselves.

Paths are folders that all executors share, as a plain path or any address that
``pyarrow.fs`` knows (``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path."""
    if "://" in path or path.startswith("file:"):
        found, root = fs.FileSystem.from_uri(path)
    else:
        found, root = fs.LocalFileSystem(), path
    return found, root.rstrip("/")


def listing(store: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    """Files of a folder and those below; a folder that is not there has none."""
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
        if info.type == fs.FileType.File:
            yield info


def put(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a whole file under its name at once; readers never see half of it."""
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, path)


def get(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as source:
        return source.read()
