"""As much of h5py's reading side as ``sources.history`` uses, over folders of chunk
files, for tests and queries where that library isn't there.

    <path>/index.json         attrs, and shape, dtype and chunks of each variable
    <path>/<name>/<a>.<b>...  a chunk, by its place in the chunk grid (numpy)
    <path>/reads/             one file for each chunk that was read, if the folder exists
"""

from __future__ import annotations

import itertools
import json
import os
import uuid

import numpy as np


class Dataset:
    def __init__(self, path: str, name: str, shape, dtype, chunks):
        self.path, self.name, self.shape, self.dtype, self.chunks = path, name, tuple(shape), np.dtype(dtype), tuple(chunks)

    def __getitem__(self, key) -> np.ndarray:
        key = key if isinstance(key, tuple) else (key,)
        if Ellipsis in key:
            at = key.index(Ellipsis)
            key = (*key[:at], *[slice(None)] * (len(self.shape) - len(key) + 1), *key[at + 1 :])
        key = (*key, *[slice(None)] * (len(self.shape) - len(key)))
        spans = [range(*k.indices(n)) if isinstance(k, slice) else range(k, k + 1) for k, n in zip(key, self.shape, strict=True)]
        out = np.zeros([len(s) for s in spans], self.dtype)
        for place in itertools.product(*(range(s.start // c, -(-s.stop // c)) for s, c in zip(spans, self.chunks, strict=True))):
            chunk = self._chunk(place)
            lows = [max(s.start, p * c) for s, p, c in zip(spans, place, self.chunks, strict=True)]
            highs = [min(s.stop, p * c + n) for s, p, c, n in zip(spans, place, self.chunks, chunk.shape, strict=True)]
            to = tuple(slice(a - s.start, z - s.start) for a, z, s in zip(lows, highs, spans, strict=True))
            out[to] = chunk[tuple(slice(a - p * c, z - p * c) for a, z, p, c in zip(lows, highs, place, self.chunks, strict=True))]
        return out.reshape([len(s) for s, k in zip(spans, key, strict=True) if isinstance(k, slice)])

    def _chunk(self, place) -> np.ndarray:
        name = ".".join(map(str, place))
        if os.path.isdir(f"{self.path}/reads"):
            with open(f"{self.path}/reads/{self.name}-{name}-{uuid.uuid4().hex}", "w"):
                pass
        return np.load(f"{self.path}/{self.name}/{name}.npy")


class File(dict):
    def __init__(self, path: str, mode: str = "r"):
        with open(f"{path}/index.json") as f:
            index = json.load(f)
        super().__init__({n: Dataset(path, n, **own) for n, own in index["variables"].items()})
        self.attrs = index["attrs"]

    def __enter__(self) -> File:
        return self

    def __exit__(self, *exc) -> bool:
        return False


def write_index(path: str, variables: dict[str, tuple], attrs: dict) -> None:
    """``variables``: name to (shape, dtype, chunks)."""
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/index.json", "w") as f:
        json.dump({"attrs": attrs, "variables": {n: dict(zip(("shape", "dtype", "chunks"), (list(s), str(d), list(c)), strict=True)) for n, (s, d, c) in variables.items()}}, f)


def write_chunk(path: str, name: str, place, values: np.ndarray) -> None:
    """A chunk, whole or not at all, so a task that runs twice does no harm."""
    os.makedirs(f"{path}/{name}", exist_ok=True)
    own = f"{path}/{name}/{uuid.uuid4().hex}.tmp.npy"
    np.save(own, values)
    os.replace(own, f"{path}/{name}/{'.'.join(map(str, place))}.npy")


def write_file(path: str, data: dict[str, np.ndarray], chunks: dict[str, tuple], attrs: dict) -> None:
    write_index(path, {n: (v.shape, v.dtype, chunks[n]) for n, v in data.items()}, attrs)
    for n, v in data.items():
        for place in itertools.product(*(range(-(-s // c)) for s, c in zip(v.shape, chunks[n], strict=True))):
            write_chunk(path, n, place, v[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunks[n], strict=True))])
