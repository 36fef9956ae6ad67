"""Whole Arrow batches of texts as byte buffers, cut into words with numpy.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(space and 0x09 to 0x0D), which for UTF-8 equals the same rule on code points.
All helpers take null texts as empty ones and never cut a text: a text longer
than a slice is worked on alone, by one task, with 20 to 40 bytes of arrays per
byte of it, so the longest text times that must fit into a Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once inside a task; a longer single text
# is worked on alone.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges ``(first, end, bytes, offsets)`` of at most ``limit`` bytes
    each (one row at least); ``offsets`` has ``end - first + 1`` places into ``bytes``."""
    n = len(texts)
    if n == 0:
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset: texts.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        at = offsets[first: end + 1]
        yield first, end, whole[at[0]: at[-1]], at - at[0]
        first = end
    # Workers are kept for later tasks; what this batch took is not.
    pa.default_memory_pool().release_unused()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


@dataclass
class Words:
    """The words of a slice: byte ranges, and ``first[d]:first[d + 1]`` are those of row d."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    inside: np.ndarray  # per byte: part of a word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return runs(~_SPACE[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of marked bytes, cut where a text ends."""
    before = np.zeros(len(inside), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(inside), dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(inside)]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), inside)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None) -> pa.Array:
    """The byte ranges as an Arrow binary array; ``inside`` marks their bytes
    if they do not cover ``data`` without gaps."""
    compact = data if inside is None else data[inside]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(compact))])


def encode_words(data: np.ndarray, w: Words) -> tuple[np.ndarray, pa.Array]:
    """An id for each word, and the distinct words by id (exact, no hashing)."""
    coded = pieces(data, w.starts, w.ends, w.inside).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte place (and the end), the code points that begin before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x
