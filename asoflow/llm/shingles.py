"""Word shingles of whole texts as 64-bit fingerprints, computed on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_LONG_WORD = 256  # bytes; longer words are fingerprinted by xxhash
_CHUNK = 1 << 20  # bytes of text worked on at once (or one document)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on whole arrays."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTES = bytes(_LOWER.tolist())
_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))[_LOWER]
_PLACE = _mix(np.arange(1001, 1001 + _LONG_WORD, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_STEP = _mix(np.arange(5001, 5065, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each row starts in them (nulls are empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about _CHUNK bytes."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + _CHUNK, "right")) - 1)
        yield lo, min(hi, len(at) - 1)
        lo = hi


def word_prints(data: np.ndarray, at: np.ndarray, table: np.ndarray = _BYTE, fold: bytes | None = _LOWER_BYTES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of some rows, and how many words lie before each row's start.

    table has a number for each byte; fold maps the bytes of long words, which have a hash with that seed (None: as they are).
    """
    base = int(at[0])
    buf = data[base : int(at[-1])]
    at = at - base
    if not len(buf):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    solid = ~_SPACE[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = solid[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    word = np.cumsum(begins) - 1
    place = np.arange(len(buf)) - starts[word]
    value = np.where(solid, table[buf] * _PLACE[np.clip(place, 0, _LONG_WORD - 1)], U(0))
    prints = np.add.reduceat(value, starts)
    sizes = np.add.reduceat(solid.astype(np.int64), starts)
    for i in np.flatnonzero(sizes > _LONG_WORD):
        prints[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + sizes[i]].tobytes().translate(fold), seed)
    prints = _mix(prints + sizes.astype(U) * U(0xD6E8FEB86659FD93))
    return prints, np.searchsorted(starts, at, "left")


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct fingerprints of its shingles of so many words; a shorter
    text counts as one shingle, a text without words gives none."""
    data, at = text_buffers(column)
    for lo, hi in chunks(at):
        prints, before = word_prints(data, at[lo : hi + 1])
        n = len(prints)
        whole = n - words + 1
        if whole > 0:
            rolled = prints[:whole] * _STEP[0]
            for j in range(1, words):
                rolled = rolled + prints[j : whole + j] * _STEP[j]
            rolled = _mix(rolled)
        for k in range(hi - lo):
            a, b = int(before[k]), int(before[k + 1])
            if b - a >= words:
                yield _sorted_distinct(rolled[a : b - words + 1])
            elif b > a:
                yield _mix((prints[a:b] * _STEP[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
            else:
                yield prints[:0]


def _sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def digest(x: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that name a set of fingerprints."""
    a = _mix(x ^ U(0x243F6A8885A308D3)).sum(dtype=U)
    b = _mix(x + U(0x13198A2E03707344)).sum(dtype=U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of fingerprints (or halves of them) as one Arrow list column of signed numbers."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays or [np.zeros(0, U)])
    flat = flat.view(np.int32 if flat.dtype == np.uint32 else np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
