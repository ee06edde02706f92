"""Byte access for data sources and writers through pyarrow's file systems, so that any shared store will do."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(path: str, start: int = 0, length: int | None = None) -> bytes:
    store, inner = resolve(path)
    with store.open_input_file(inner) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


def size(path: str) -> int:
    store, inner = resolve(path)
    return store.get_file_info(inner).size


def exists(path: str) -> bool:
    store, inner = resolve(path)
    return store.get_file_info(inner).type == fs.FileType.File


def write_bytes(path: str, data: bytes) -> None:
    store, inner = resolve(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(data)
