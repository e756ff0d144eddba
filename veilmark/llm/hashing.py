"""Vectorised hashing over Arrow string buffers: words, lines, byte windows. Whole texts, no Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | U(1)  # a random odd value per byte
BASE = U(0x9E3779B97F4A7C15)
BASE2 = U(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18
_powers = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 ... base**(n-1) mod 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1024), base, dtype=np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 1 << 20:
            return out[:n]
        _powers[int(base)] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, a longer row by itself."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(data: np.ndarray, inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True in inside that stay within one row."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offs[:-1][(offs[:-1] < len(data)) & (offs[1:] > offs[:-1])]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of values[s:e] for each span. values: uint64 per byte. Spans may be empty or overlap not at all."""
    out = np.zeros(len(starts), dtype=np.uint64)
    lens = ends - starts
    full = lens > 0
    if full.any():
        n = lens[full]
        at = np.cumsum(n) - n
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(at, n)
        where = within + np.repeat(starts[full], n)
        out[full] = np.add.reduceat(values[where] * powers(int(n.max()), base)[within], at)
    return mix(out + lens.astype(np.uint64) * BASE2)


def words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of words of each row. Words: runs of bytes other than \\x20 and \\x09-\\x0D."""
    starts, ends = pieces(data, ~SPACE[data], offs)
    values = BYTE[LOWER[data] if lower else data]
    per_row = np.searchsorted(starts, offs[1:]) - np.searchsorted(starts, offs[:-1])
    return span_hashes(values, starts, ends), per_row


def windows(values: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of each k values in a row, by doubling; n - k + 1 of them, unmixed."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    out, done, step, size, weight = None, 0, values, 1, int(base)
    while True:
        if k & size:
            if out is None:
                out, done = step, size
            else:  # what is done so far, followed by the next size values
                n = len(values) - done - size + 1
                out, done = out[:n] * U(weight) + step[done : done + n], done + size
        if size * 2 > k:
            return out[: len(values) - k + 1]
        n = len(values) - 2 * size + 1
        step, size, weight = step[:n] * U(weight) + step[size : size + n], size * 2, weight * weight % 2**64
