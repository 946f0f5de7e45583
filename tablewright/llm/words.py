"""Words of a batch of texts as numpy arrays: byte spans and 64-bit hashes.

The texts of a batch are one byte array; word boundaries and word hashes are
computed for all of it at once (a polynomial hash from running sums), so the
cost per byte is a few array passes and no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Fixed value: an odd multiplier of the polynomial hash (any odd 64-bit number serves).
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: list[np.ndarray] = []


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown as needed and kept."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x & _MASK, np.uint64)])) for x in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


#: Bytes hashed at once; bounds the tables and temporary arrays.
_BLOCK = 1 << 18


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] of each span; spans are in order."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, origin + _BLOCK, side="right")))
        codes = _BYTE_CODES[data[origin : ends[stop - 1]]]
        up, down = _table(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=sums[1:])
        a, b = starts[at:stop] - origin, ends[at:stop] - origin
        out[at:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = stop
    return out


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    found = b"".join([blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, np.uint64)


def digest_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 64 bits of BLAKE2b of each span. Spans of 16 bytes and less are compared as two
    numbers, and equal ones that meet in sorted order are hashed once."""
    n = ends - starts
    out = np.empty(len(n), np.uint64)
    body = data.tobytes()
    at = np.flatnonzero(n > 16)
    out[at] = _digests(body, starts[at], ends[at])
    at = np.flatnonzero(n <= 16)
    if not len(at):
        return out
    first, size = starts[at], n[at]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = eight[first] & mask[np.minimum(size, 8)]
    high = eight[first + 8] & mask[np.clip(size - 8, 0, 8)]
    order = np.argsort(mix(low + mix(high + size.astype(np.uint64))))
    low, high, size = low[order], high[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size[1:] != size[:-1])
    kinds = at[order[new]]
    out[at[order]] = _digests(body, starts[kinds], ends[kinds])[np.cumsum(new) - 1]
    return out


@dataclass
class Words:
    """Words of a batch: byte starts and ends, the row of each, hashes, and rows' first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # rows + 1: words of row i are bounds[i] to bounds[i + 1]

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


#: White space that separates words is tab to carriage return, and the space.
SEPARATES = np.zeros(256, bool)
SEPARATES[[32, *range(9, 14)]] = True


def words(column: pa.Array, lower: bool = True, separates: np.ndarray = SEPARATES, hasher=span_hashes) -> Words:
    raw, offsets = text_bytes(column)
    data = lower_ascii(raw) if lower else raw
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separates[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # a word does not cross texts
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    hashes = hasher(data, starts, ends)
    return Words(raw, starts, ends, hashes, np.searchsorted(starts, offsets))


def slices(batch: pa.RecordBatch, text: int, most: int = 4_000_000):
    """A batch in slices of about ``most`` text bytes (at least one row each)."""
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
