"""Words and their 64-bit hashes over whole Arrow text columns, without a Python object per word.

A batch of texts stays one byte buffer: word bounds, word hashes and hashes of word runs are numpy passes over it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * i) - 1 if i < 8 else (1 << 64) - 1 for i in range(9)], np.uint64)
_A, _B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator: a bijection of 64 bits."""
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` text bytes, so that memory follows neither the batch size nor the other rows.

    A text longer than that is a slice of its own. Arrow's free memory goes back after each batch, as workers live for many stages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(lengths) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, padded by eight zeros, and the offsets of its texts; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR):
    """Start and end byte of each word, and the number of its text; a word never spans two texts."""
    n = int(offsets[-1])
    inside = ~separator[data[:n]]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    length = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix((length.astype(np.uint64) + np.uint64(seed)) * _STEP)
    h = mix(h ^ (eight[starts] & _KEEP[np.minimum(length, 8)]))
    at, rest = 8, np.flatnonzero(length > 8)
    while rest.size:
        h[rest] = mix(h[rest] ^ (eight[starts[rest] + at] & _KEEP[np.minimum(length[rest] - at, 8)]))
        at += 8
        rest = rest[length[rest] > at]
    return h


def hash_runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes; one value per start, none for the last ``size - 1``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= _STEP
        h ^= h >> np.uint64(32)
        h += words[k:k + n]
    return mix(h)


def same_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal integer ``keys`` in a sorted stream, a table a run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(np.r_[0, cut], np.r_[cut, batch.num_rows], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield pa.Table.from_batches(held)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` compressed text by text as ``packed``, for a shuffle that carries whole texts; other columns stay."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for part in pieces(batches, "text"):
        data, offsets = text_bytes(part.column("text"))
        raw = memoryview(data)
        packed = [squeeze.compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        names = [n for n in part.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(packed, pa.binary())], [*names, "packed"])


def unpacked(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` packed bytes with ``text`` in place of ``packed``."""
    unpack = zstandard.ZstdDecompressor()
    for part in pieces(batches, "packed", most):
        names = [n for n in part.schema.names if n != "packed"]
        texts = pa.array([unpack.decompress(p) for p in part.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), texts], [*names, "text"])
