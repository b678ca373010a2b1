"""Words of a batch of texts as numpy arrays, without a Python object per word.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text
(no byte of a multi-byte character lies in that class).  Two words are taken as
equal when their 64-bit hashes are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from idlecost.llm.common import SPACE_BYTES

#: Bytes of text that are worked on at once (one longer text is worked on alone).
SLICE_BYTES = 2 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32
_MASK = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 9)], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def free_memory() -> None:
    """Give freed memory back to the system: an idle Python worker keeps its process, and with it all it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words(NamedTuple):
    """Words of consecutive texts: word ``w`` of the slice spans data[start[w]:start[w] + length[w]];
    text ``d`` has the words first[d]:first[d + 1] and the bytes offset[d]:offset[d + 1]."""

    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES, rows: int = 65_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of consecutive rows with at most ``limit`` bytes together (one row at least)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), at + rows, len(texts))
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offset: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offset, none, none, np.zeros(len(offset), dtype=np.int64))
    letter = ~IS_SPACE[data]
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    border = offset[:-1][offset[:-1] < n]
    begin[border] = letter[border]
    end = letter.copy()
    end[:-1] &= ~letter[1:]
    border = offset[1:][offset[1:] > 0] - 1
    end[border] = letter[border]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(end) + 1 - start
    return Words(data, offset, start, length, np.searchsorted(start, offset))


def mix(h: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    h = mix(w.length.astype(np.uint64) + _ODD[0])
    if not len(h):
        return h
    padded = np.concatenate([w.data, np.zeros(8, dtype=np.uint8)])
    loads = np.ndarray(shape=(len(w.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    todo, at, left = np.arange(len(h)), w.start.copy(), w.length.copy()
    while len(todo):
        h[todo] = mix((h[todo] * _ODD[1]) ^ (loads[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def window_hashes(h: np.ndarray, width: int = 5) -> np.ndarray:
    """A hash of each ``width`` consecutive words of the slice (windows may cross texts)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = h[:n] * _ODD[0]
    for k in range(1, width):
        total += h[k:k + n] * _ODD[k]
    return mix(total)
