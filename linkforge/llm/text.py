"""Texts of Arrow batches as numpy bytes, and hashes of their words and word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so that memory does not follow the batch.
SLICE = 1 << 20
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, 256 + 64, dtype=np.uint64) | _U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about size bytes; a longer text comes alone."""
    _, off = raw(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    return x * _U(0x94D049BB133111EB) ^ (x >> _U(33))


@cache
def _places(log: int) -> np.ndarray:
    """An odd multiplier for each place in a word, drawn apart from all others."""
    return mix(np.arange(1, (1 << log) + 1, dtype=np.uint64) * _U(_MULT)) | _U(1)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, first): each word's hash, its first byte, and for each document the number of its first word.

    Words are runs without ASCII white space; A-Z count as a-z. A hash is a sum of one term a byte, of the byte and its
    place, mixed: no polynomial, so words made of the same parts in another order don't meet.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    new = np.empty(n, bool)
    new[0], new[1:] = True, ~inside[:-1]
    new[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(inside & new)
    if not len(start):
        return np.zeros(0, np.uint64), start, np.zeros(len(off), np.int64)
    held = np.flatnonzero(inside)
    first = np.searchsorted(held, start)  # each word's first byte among those of words
    size = np.diff(first, append=len(held))
    place = np.arange(len(held)) - np.repeat(first, size)
    terms = _SEEDS[LOWER[buf[held]]] * _places(max(12, int(size.max()).bit_length()))[place]
    h = np.add.reduceat(terms, first)
    return mix(h + size.astype(np.uint64) * _U(_MULT)), start, np.searchsorted(start, off)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; of a shorter one, the hash of all its words."""
    out = []
    run = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(h) >= k else 0):
        run += h[j : len(h) - k + 1 + j] * _SEEDS[256 + j]
    run = mix(run)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(run[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((h[a:b] * _SEEDS[256 : 256 + b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Numpy arrays as a list column."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))
