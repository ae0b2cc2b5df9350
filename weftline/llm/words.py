"""Vectorised word kernel: word bounds, 64-bit word hashes and n-gram hashes of a whole Arrow batch.

Works on the UTF-8 bytes of a string array without making Python strings.  All splitting bytes are ASCII, so
multi-byte characters are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from weftline.llm.common import plain

_CHUNK = 1 << 16
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POW: list[np.ndarray] = []

#: Bytes of a word `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, _CHUNK + 1)
        _POW[:] = [_powers(int(_R), size), _powers(pow(int(_R), -1, 1 << 64), size)]
    return _POW[0], _POW[1]


@dataclass
class Words:
    """Words of some rows: byte bounds in ``data``, hashes, and ``rows[r]:rows[r+1]`` as row r's words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def split(column: pa.Array, word_bytes: np.ndarray = SPACED, lower: bool = False, hashed: bool = True) -> Words:
    column = plain(column)
    n = len(column)
    empty = np.empty(0, np.int64)
    if not n:
        return Words(np.empty(0, np.uint8), empty, empty, np.zeros(1, np.int64), np.empty(0, np.uint64))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    if not inside.any():
        return Words(data, empty, empty, np.zeros(n + 1, np.int64), np.empty(0, np.uint64))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, rows, hash_spans(data, starts, ends) if hashed else np.empty(0, np.uint64))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which ascend and don't overlap, in chunks of bounded memory."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        lo, hi = starts[at], ends[to - 1]
        power, inverse = _tables(int(hi - lo) + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _STEP)
        at = to
    return out


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on; mind row ends with ``whole``."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _STEP + hashes[j : j + m]
    return mix(out + np.uint64(n))


def whole(rows: np.ndarray, n: int) -> np.ndarray:
    """Mask over n-gram places: True where the n words lie in one row."""
    total = int(rows[-1])
    m = total - n + 1
    if m <= 0:
        return np.empty(0, bool)
    ends = np.repeat(rows[1:], np.diff(rows))
    return np.arange(n, m + n) <= ends[:m]


def by_row(rows: np.ndarray, keys: np.ndarray, n_rows: int) -> np.ndarray:
    """Sorting by row, then by 64-bit key.

    One sort of row and leading key bits packed together; the keys' last bits decide only if packed values of different
    keys tie, and then all is sorted by both."""
    bits = np.uint64(max(1, (n_rows - 1).bit_length()))
    packed = (rows.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits)
    by = np.argsort(packed)
    packed = packed[by]
    tied = np.flatnonzero(packed[1:] == packed[:-1])
    if (keys[by[tied]] != keys[by[tied + 1]]).any():
        return np.lexsort((keys, rows))
    return by


def cover(starts: np.ndarray, lengths: np.ndarray | int, total: int) -> np.ndarray:
    """Mask of the words inside any of the spans."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0
