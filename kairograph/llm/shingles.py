"""Hashed word shingles of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
CHUNK = 1 << 14


def hashed_shingles(text: str | None, size: int, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text in order, in chunks; a text of fewer words is one shingle, one without words none."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    space = np.concatenate([[True], IS_SPACE[data], [True]])
    first = np.flatnonzero(space[:-2] & ~space[1:-1])
    if not len(first):
        return
    lengths = np.flatnonzero(space[2:] & ~space[1:-1]) + 1 - first
    # The words with one blank between them, in which every shingle is a slice.
    data, keep = data.copy(), ~space[1:-1]
    data[first[1:] - 1], keep[first[1:] - 1] = 32, True
    line = data[keep].tobytes()
    stops = np.cumsum(lengths + 1)
    n = max(1, len(first) - size + 1)
    starts, ends = (stops - lengths - 1)[:n], (stops - 1)[-n:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, chunk):
        part = zip(starts[i : i + chunk].tolist(), ends[i : i + chunk].tolist(), strict=True)
        yield np.array([digest(line[a:b], SEED) for a, b in part], dtype="<u8")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes, sorted."""
    parts = list(hashed_shingles(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")
