"""Vectorised word and shingle hashing over the bytes of Arrow text columns.

A batch is cut into slices of a few MB at row boundaries; all work on a slice is numpy on one byte
array, so no Python object is made for each word. Nothing here keeps more than one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that part words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside 0-9, A-Z, a-z and those of non-ASCII characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins (one more than rows). Null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about SLICE_BYTES of text, with the text's bytes and row starts."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        raw, at = text_bytes(batch.column(k))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(row, end - row), raw[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of its first word (one more than rows)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~separator[raw]
    new = np.zeros(len(raw) + 1, bool)
    new[at] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | new[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | new[1:])) + 1
    return begins, ends, np.searchsorted(begins, at)


def span_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A rolling hash of each run of ``size`` bytes; its high bits are the good ones."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: len(raw) - size + 1] * np.uint64(0x9E3779B97F4A7C15)


def rows_of(first: np.ndarray) -> np.ndarray:
    """For each word its row's number."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one row."""
    n = len(hashes)
    out = hashes.copy()
    for j in range(1, min(k, n)):
        out[: n - j] = mix(out[: n - j] * np.uint64(0x9FB21C651E98DF25) + hashes[j:])
    last = np.repeat(first[1:], np.diff(first))
    return out, np.arange(n) + k <= last


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row's words; 0 for a row without words."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
