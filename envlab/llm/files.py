"""Binary files in the shared folder, written and read by tasks.

``pyarrow.fs`` resolves the folder's URI (local, object store, HDFS), so the same code serves any
shared folder. Every task attempt writes files of its own name and reports them in its output rows;
only files reported by attempts that Spark accepted are ever read, so a lost executor or a repeated
task leaves at most an unread file behind.
"""
from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Appender:
    """A new file ``<folder>/<stem>-<unique><suffix>``; ``at`` is the number of bytes written."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        fs, path = locate(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = fs.open_output_stream(path, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._out.close()


def open_stream(uri: str):
    """Sequential reader."""
    fs, path = locate(uri)
    return fs.open_input_stream(path, compression=None)


def open_random(uri: str):
    """Reader with ``read_at(n, offset)``."""
    fs, path = locate(uri)
    return fs.open_input_file(path)
