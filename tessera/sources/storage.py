"""Byte access to files by path or URI, for tasks and for the driver."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from typing import IO


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or a plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if os.path.isabs(uri) else None


def read_range(uri: str, offset: int, size: int) -> bytes:
    """Up to ``size`` bytes from ``offset`` on."""
    if (path := local_path(uri)) is not None:
        with open(path, "rb") as file:
            file.seek(offset)
            return file.read(min(size, os.path.getsize(path)))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        file.seek(offset)
        return file.read(size)


@contextmanager
def writing(uri: str) -> Iterator[IO[bytes]]:
    """A file to write to that becomes whole or isn't there: written aside, synced, then moved into place."""
    passing = f"{uri}.{uuid.uuid4().hex}.part"
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        aside = local_path(passing)
        try:
            with open(aside, "wb") as file:
                yield file
                file.flush()
                os.fsync(file.fileno())
            os.replace(aside, path)
        except BaseException:
            with suppress(FileNotFoundError):
                os.remove(aside)
            raise
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    aside = fs.FileSystem.from_uri(passing)[1]
    with store.open_output_stream(aside) as file:
        yield file
    store.move(aside, path)


def write_whole(uri: str, data: bytes) -> None:
    """A whole file or none."""
    with writing(uri) as file:
        file.write(data)


def size_of(uri: str) -> int:
    if (path := local_path(uri)) is not None:
        return os.path.getsize(path)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.get_file_info(path).size


def append(uri: str, data: bytes, at: int) -> None:
    """Puts bytes at the end of a file of size ``at``; done again, it changes nothing."""
    if (path := local_path(uri)) is None:
        raise OSError("this store has no files that grow: copy the blob first")
    with open(path, "r+b") as file:
        file.seek(at)
        file.write(data)
        file.truncate()
        file.flush()
        os.fsync(file.fileno())


def read_header(uri: str, size: int = 16) -> bytes:
    """A file's first bytes, or none if it can't be read."""
    try:
        return read_range(uri, 0, size)
    except OSError:
        return b""
