"""Binary files written by the tasks that hold them."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def store_file(path: str, data: bytes, overwrite: bool) -> str:
    """Write to a temporary name and rename, so a reader never sees half a file and a task that
    runs twice leaves the same file. For folders that all executors share by a mount; paths of an
    object store need a ``store`` of the caller."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"not a mounted folder: {path}")
    if not overwrite and os.path.exists(path):
        return "exists"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
    return "written"


def write_files(
    rows: DataFrame,
    folder: str,
    path: str,
    content: str,
    overwrite: bool = True,
    store: Callable[[str, bytes, bool], str] = store_file,
) -> DataFrame:
    """Store each row's bytes under ``folder`` and return the manifest (path, n_bytes, status).

    Writing happens when the manifest is computed. Rows without bytes are not written. A folder with
    a scheme, such as an object store's, is refused here unless the caller gives a ``store`` for it.
    """
    if store is store_file and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        raise ValueError(f"not a mounted folder: {folder}")
    schema = T.StructType(
        [
            T.StructField(path, T.StringType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("status", T.StringType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for name, data in zip(frame[path], frame[content]):
                # Names come from crawled links; none may lead out of the folder.
                inside = not os.path.isabs(name) and ".." not in name.split("/")
                status = store(os.path.join(folder, name), data, overwrite) if inside else "refused"
                done.append((name, len(data), status))
            yield pd.DataFrame(done, columns=schema.names)

    held = rows.select(path, content)
    return held.filter(held[content].isNotNull() & held[path].isNotNull()).mapInPandas(run, schema)
