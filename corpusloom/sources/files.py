"""Whole small files in shared folders, written and read by executors through Arrow's file systems (local paths, hdfs://, s3://, gs://)."""

from __future__ import annotations

import re
import uuid

from pyarrow import NativeFile, fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put(uri: str, data: bytes) -> None:
    """Writes beside the name and then moves: a file is seen whole or not at all."""
    store, path = _resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        out.write(data)
    store.move(part, path)


def contents(folder: str, suffix: str) -> list[bytes]:
    """Of all files of a folder with a suffix, in order of names; none if there is no folder."""
    store, path = _resolve(folder)
    out = []
    for f in sorted(store.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
        if f.is_file and f.path.endswith(suffix):
            with store.open_input_stream(f.path) as data:
                out.append(data.read())
    return out


def open_input(uri: str) -> NativeFile:
    store, path = _resolve(uri)
    return store.open_input_file(path)
