"""Whole binary files in the shared folder, written and read by executors."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark import TaskContext


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write(uri: str, data: bytes) -> None:
    """Write a file under a name of this attempt's own and rename it: readers see all of it or nothing."""
    task = TaskContext.get()
    temporary = f"{uri}.{task.taskAttemptId() if task else 'driver'}.tmp"
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(temporary), "wb") as out:
            out.write(data)
        os.replace(_local(temporary), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(f"{path}{temporary[len(uri):]}") as out:
        out.write(data)
    store.move(f"{path}{temporary[len(uri):]}", path)


def read(uri: str) -> bytes:
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as source:
            return source.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source:
        return source.read()
