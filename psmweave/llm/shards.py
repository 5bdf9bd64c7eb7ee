"""Sorted arrays in files of the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under a name of its own and move it into place, so that a repeated task does no harm."""
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    target, draft = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    files.move(draft, target)


_OPEN: dict[str, dict[str, np.ndarray]] = {}


def load(folder: str, name: str, dtype: np.dtype | str, n: int) -> np.ndarray:
    """The array, mapped; a worker maps each file once. Files that aren't on a mounted folder are
    copied to a nameless local file first, which goes with its last mapping."""
    if folder not in _OPEN:
        _OPEN.clear()
        _OPEN[folder] = {}
    known = _OPEN[folder]
    if name not in known:
        if n == 0:
            known[name] = np.empty(0, dtype)
        else:
            files, root = fs.FileSystem.from_uri(folder)
            if isinstance(files, fs.LocalFileSystem):
                known[name] = np.memmap(f"{root}/{name}", dtype, "r", shape=(n,))
            else:
                with tempfile.NamedTemporaryFile() as copy:
                    with files.open_input_stream(f"{root}/{name}") as source:
                        while part := source.read(1 << 24):
                            copy.write(part)
                    copy.flush()
                    os.fsync(copy.fileno())
                    known[name] = np.memmap(copy.name, dtype, "r", shape=(n,))
    return known[name]


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, all lowest bytes first and so on, which the shuffle's compression shrinks."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with how often they occur."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shard_of(x: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of 64-bit integers holds each value."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
