"""Arrow string columns as flat bytes, and word and shingle fingerprints of them, by whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240101)
#: A random 64-bit value for each byte; upper-case A-Z share theirs with the lower-case letters.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: An odd base, its inverse modulo 2**64, and odd factors for the words of a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
FACTORS = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are handled at once, about; a longer word makes a longer block.
BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string column without copying; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (at[0], at[-1]) if len(at) else (0, 0)
    starts, ends = at[:-1] - lo, at[1:] - lo
    if column.null_count:
        ends = np.where(np.asarray(column.is_null()), starts, ends)
    return bytes_[lo:hi], starts, ends


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n at least."""
    key = int(base)
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        filled = 1
        while filled < size:
            step = np.uint64(pow(key, filled, 2**64))
            out[filled : 2 * filled] = out[:filled] * step
            filled *= 2
        _powers[key] = out
    return _powers[key]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of values[start:end] for each span, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values))[: len(values)], out=total[1:])
    part = (total[ends] - total[starts]) * powers(INVERSE, len(values) + 1)[starts]
    return mixed(part + (ends - starts).astype(np.uint64) * FACTORS[15])


def _cut(data: np.ndarray, starts: np.ndarray, at: int) -> int:
    """Where a block from at on may end: after a blank or before a text, so that it holds whole words."""
    end = at + BLOCK
    if end >= len(data):
        return len(data)
    blank = np.flatnonzero(SPACE[data[at:end]])
    first = int(np.searchsorted(starts, end, "right")) - 1
    best = max(at + int(blank[-1]) + 1 if len(blank) else at, int(starts[first]))
    if best > at:
        return best
    while end < len(data):  # a word longer than a block
        blank = np.flatnonzero(SPACE[data[end : end + BLOCK]])
        first = int(np.searchsorted(starts, end, "left"))
        stops = [end + int(blank[0])] if len(blank) else []
        stops += [int(starts[first])] if first < len(starts) and starts[first] <= end + BLOCK else []
        if stops:
            return min(stops)
        end += BLOCK
    return len(data)


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every word, texts in turn, and the number of words of each text; by blocks of whole words."""
    counts, found, at = np.zeros(len(starts), np.int64), [np.zeros(0, np.uint64)], 0
    while at < len(data):
        stop = _cut(data, starts, at)
        block = data[at:stop]
        inside = ~SPACE[block]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = slice(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, stop, "left")))
        lo, hi = np.maximum(starts[rows] - at, 0), np.minimum(ends[rows], stop) - at
        cuts = lo[(lo > 0) & (hi > lo)]
        first[cuts] = inside[cuts]  # a text's first word is no part of the text before
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        counts[rows] += np.searchsorted(begin, hi) - np.searchsorted(begin, lo)
        found.append(span_hashes(BYTE[block], begin, end))
        at = stop
    return np.concatenate(found), counts


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingle fingerprints of each text."""
    word, counts = words(*flat(column))
    ends = np.cumsum(counts)
    total = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        total += word[k : k + len(total)] * FACTORS[k]
    total = mixed(total)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(total[end - count : end - n + 1]))
        elif count:
            short = np.uint64(count)
            with np.errstate(over="ignore"):
                for k in range(count):
                    short = short * np.uint64(31) + word[end - count + k] * FACTORS[8 + k]
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
