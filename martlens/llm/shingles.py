"""Word shingles of whole texts, as 64-bit hashes, computed on whole Arrow batches with numpy.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR; A-Z are lower-cased first. UTF-8
multi-byte sequences never contain those bytes, so working on bytes gives the same words as working on code points.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in slices of about this many bytes, so that scratch arrays stay small however long the batch is.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """An invertible mixing of 64-bit words (splitmix finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables["up"], _tables["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _tables["up"][:n], _tables["down"][:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of each word of a byte array."""
    starts, ends = word_spans(data)
    up, down = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), starts


@functools.cache
def _c_library():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Returns to the system what Arrow's pool and the C library keep of freed memory: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if (libc := _c_library()) is not None:
        libc.malloc_trim(0)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, start of each text in the bytes and their end) of runs of texts; each text ends with a line feed.

    At the end memory that earlier batches have freed is given back.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(texts):
        room = np.cumsum(lengths[at:] + 1)
        to = at + max(1, int(np.searchsorted(room, size, side="right")))
        part = "\n".join([*texts.slice(at, to - at).fill_null("").to_pylist(), ""])
        data = np.frombuffer(part.encode(), np.uint8)
        yield at, to, data, np.concatenate([[0], np.cumsum(lengths[at:to] + 1)])
        at = to
    give_back()


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, in order, the sorted distinct hashes of its k-word shingles.

    A text of fewer words has its whole word sequence as its one shingle; a null text or one without words has none.
    """
    seeds = mix64(np.arange(1, k + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    for first, last, data, bounds in slices(texts):
        hashes, starts = word_hashes(data)
        at = np.searchsorted(starts, bounds)
        full = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            full += hashes[j : len(full) + j] * seeds[j]
        full = mix64(full)
        for i in range(last - first):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                grams = np.sort(full[a : b - k + 1])
                keep = np.empty(len(grams), bool)
                keep[0] = True
                np.not_equal(grams[1:], grams[:-1], out=keep[1:])
                yield grams[keep]
            elif b > a:
                few = hashes[a:b] * seeds[: b - a]
                yield mix64(np.array([few.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
