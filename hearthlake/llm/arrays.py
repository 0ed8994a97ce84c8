"""Texts and lists of numbers as flat arrays, for work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_array(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings whose buffers begin at its first row."""
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pa.concat_arrays([x.cast(pa.string()), pa.array([], pa.string())])


def buffers_of(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string array."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = memoryview(data)[ends[0] : ends[-1]] if data is not None else memoryview(b"")
    return ends - ends[0], raw


def utf8_lengths(points: np.ndarray) -> np.ndarray:
    """As bytes; sums of them need a wider type."""
    sizes = np.ones(len(points), np.uint8)
    for least in (0x7F, 0x7FF, 0xFFFF):
        sizes += points > least
    return sizes


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the first one's place of each."""
    ends, raw = buffers_of(texts)
    points = np.frombuffer(bytes(raw).decode().encode("utf-32-le"), np.uint32)
    at = np.zeros(len(points) + 1, np.int64 if len(raw) >> 31 else np.int32)
    np.cumsum(utf8_lengths(points), out=at[1:])
    return points, np.searchsorted(at, ends[:-1].astype(at.dtype))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


def slices(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] for each start, one after the other."""
    total = int(sizes.sum())
    kind = np.int64 if max(total, len(values)) >> 31 else np.int32  # half the memory where it does
    at = np.repeat((starts - starts_of(sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return values[at]


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values, as long as sizes say."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, stop) of consecutive stretches of about ``most`` bytes; a longer text is whole."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        stop = min(len(texts), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1)
        yield at, stop
        at = stop
