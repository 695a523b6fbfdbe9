"""Whole files in the shared folder, written and read by executors through Arrow's file systems (local paths, hdfs://, s3://, gs://)."""

from __future__ import annotations

import re
import uuid
from typing import BinaryIO

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_whole(uri: str, data: bytes | list[bytes]) -> None:
    """Writes beside the name and then moves, so that a retried task replaces a file by an equal one and none is seen half written."""
    store, path = resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        for piece in [data] if isinstance(data, bytes) else data:
            out.write(piece)
    store.move(part, path)


def open_input(uri: str) -> BinaryIO:
    store, path = resolve(uri)
    return store.open_input_file(path)
