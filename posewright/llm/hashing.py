"""Word hashes of whole batches of texts in array operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
GROUP_BYTES = 500_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    return h ^ (h >> np.uint64(29))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs of word bytes; the last byte must be none. No hash is 0."""
    flat = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(is_word[flat].view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    n = len(flat) + 1
    up, down = powers(2 * GROUP_BYTES if n <= 2 * GROUP_BYTES else 1 << n.bit_length())
    sums = np.zeros(n, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts]) | np.uint64(1)


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some GROUP_BYTES characters of text; a longer text is a group of its own."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > begin and size + n > GROUP_BYTES:
            yield begin, k
            begin, size = k, 0
        size += n
    if texts:
        yield begin, len(texts)


def text_groups(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of a column of texts, some GROUP_BYTES at a time; only these become Python strings."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and size + n > GROUP_BYTES:
            yield begin, column.slice(begin, k - begin).to_pylist()
            begin, size = k, 0
        size += n
    if len(sizes):
        yield begin, column.slice(begin).to_pylist()


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as the first one and the steps from each to the next, in as few bytes each as the largest step needs."""
    steps = np.diff(values.astype(np.int64))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values[:1].astype("<i8").tobytes() + steps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, : data[0]] = raw
    return np.cumsum(steps.view("<i8").ravel())
