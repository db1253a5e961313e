"""Files that tasks write and read by themselves, in any store that pyarrow can open."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def write_new(folder: str, suffix: str, data: bytes) -> str:
    """Write a file of a new name and return its path.

    A repeated task writes another file; readers only open files that a committed manifest
    names, so what a lost task left behind is never read.
    """
    store, inside = _resolve(folder)
    store.create_dir(inside, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{inside}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder.rstrip('/')}/{name}"


def read_all(path: str) -> bytes:
    store, inside = _resolve(path)
    with store.open_input_stream(inside, compression=None) as src:
        return src.read()


def open_random(path: str):
    """A file with ``read_at(n, offset)`` and ``size()``."""
    store, inside = _resolve(path)
    return store.open_input_file(inside)


class NewFile:
    """A new file that is written piece by piece; ``offset`` is where the next piece starts."""

    def __init__(self, folder: str, suffix: str):
        store, inside = _resolve(folder)
        store.create_dir(inside, recursive=True)
        name = f"{uuid.uuid4().hex}{suffix}"
        self.path = f"{folder.rstrip('/')}/{name}"
        self._out = store.open_output_stream(f"{inside}/{name}", compression=None)
        self.offset = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.offset += len(data)

    def close(self) -> None:
        self._out.close()
