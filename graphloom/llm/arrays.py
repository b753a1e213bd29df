"""Sorted arrays as files of the shared folder: tasks write them, workers map them into memory."""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Folders whose arrays a worker keeps mapped.
KEPT_FOLDERS = 3


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith(("file:", "/")) else None


def put_array(folder: str, name: str, data: np.ndarray) -> None:
    """Write once, whole: a repeated task replaces the file by an equal one."""
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{os.getpid()}"
        data.tofile(part)
        os.replace(part, f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data.tobytes())


_mapped: dict[str, dict[str, np.ndarray]] = {}


def kept_for(folder: str) -> dict:
    """What this worker keeps for a folder; the folders used longest ago are let go."""
    got = _mapped.pop(folder, {})
    _mapped[folder] = got
    while len(_mapped) > KEPT_FOLDERS:
        del _mapped[next(iter(_mapped))]
    return got


def get_array(folder: str, name: str, dtype) -> np.ndarray:
    """A file as an array mapped into memory; empty if it was never written. A remote file is copied to one without a name, which goes with the
    mapping."""
    kept = kept_for(folder)
    if name not in kept:
        path, empty = _local(folder), np.empty(0, dtype)
        if path is not None:
            full = f"{path}/{name}"
            kept[name] = np.memmap(full, dtype, "r") if os.path.exists(full) and os.path.getsize(full) else empty
            return kept[name]
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        if store.get_file_info(f"{at}/{name}").type != fs.FileType.File:
            kept[name] = empty
            return empty
        with store.open_input_stream(f"{at}/{name}") as src, tempfile.TemporaryFile() as out:
            while block := src.read(1 << 24):
                out.write(block)
            out.flush()
            kept[name] = np.memmap(out, dtype, "r") if out.tell() else empty
    return kept[name]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted key its place in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
