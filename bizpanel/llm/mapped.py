"""Arrays as files in the shared folder, which workers map into memory instead of reading them.

A folder that is mounted is mapped in place. From any other store that pyarrow can open, a worker copies a file to an
unnamed temporary one, which is gone when the task ends, and maps that.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.fs


def _mounted(folder: str) -> str | None:
    if re.match(r"file:/", folder):
        return re.sub(r"^file:/+", "/", folder)
    return None if re.match(r"\w[\w+.-]+:", folder) else folder


def write_arrays(folder: str, kind: str, arrays: list[np.ndarray]) -> str:
    """One file with the arrays behind each other, under a name that no other attempt of the task uses."""
    name = f"{kind}-{uuid.uuid4().hex}"
    here = _mounted(folder)
    if here is not None:
        os.makedirs(here, exist_ok=True)
        with open(f"{here}/{name}.part", "wb") as file:
            for a in arrays:
                file.write(np.ascontiguousarray(a).data)
        os.replace(f"{here}/{name}.part", f"{here}/{name}")
        return name
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as file:
        for a in arrays:
            file.write(np.ascontiguousarray(a).data)
    return name


def map_arrays(folder: str, name: str | None, size: int, kinds: list[type]) -> list[np.ndarray]:
    """The arrays of a file, each of ``size`` values; without a file they are empty."""
    if not size or name is None:
        return [np.zeros(0, k) for k in kinds]
    here = _mounted(folder)
    if here is not None:
        source = f"{here}/{name}"
    else:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        source = tempfile.TemporaryFile()
        with store.open_input_stream(f"{path}/{name}") as file:
            shutil.copyfileobj(file, source)
        source.flush()
    out, at = [], 0
    for k in kinds:
        out.append(np.memmap(source, k, "r", at, (size,)))
        at += size * np.dtype(k).itemsize
    return out
