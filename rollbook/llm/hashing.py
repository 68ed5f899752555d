"""Vectorised hashes of words, lines and byte windows over many texts at a time, for use inside tasks.

Texts lie one after another in a byte array `buf`; `offs` has where each begins, and the end of the last. A hash of a
segment is a polynomial modulo 2**64 in an odd base, taken from a running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Texts handled together inside a task have about so many bytes.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over all of the result."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """BASE**i and BASE**-i, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            step = np.full(size, BASE, np.uint64)
            step[0] = 1
            cls.up = np.cumprod(step, dtype=np.uint64)
            step[1:] = pow(BASE, -1, 1 << 64)
            cls.down = np.cumprod(step, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each segment; it knows the length too."""
    up, down = Powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k values of h in a row: len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, part, span = None, 0, h, 1
    while True:
        if k & span:
            n = len(h) - k + 1
            piece = part[have:have + n]
            out = piece.copy() if out is None else out * np.uint64(BASE) + piece
            have += span
        if have == k:
            return mix(out)
        part = mix(part[:-span] * np.uint64(0xA0761D6478BD642F) + part[span:])
        span *= 2


def texts(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, buf, offs) for pieces of a string column; null is an empty text."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    if not len(column):
        return
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words ([^\\x20\\x09-\\x0D]+ within one text) start and end, and the number of each text's first word."""
    inside = ~SPACE[buf]
    before, after = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    after[:-1] = inside
    after = after[1:]
    before = before[:-1]
    cut = offs[1:-1]
    cut = cut[cut < len(buf)]
    before[cut] = False
    last = offs[1:-1]
    last = last[last > 0]
    after[last - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def room(first: np.ndarray, width: int) -> np.ndarray:
    """Whether `width` tokens from each token on lie in one text; first: the number of each text's first token, and the end."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(first[-1])
    return left >= width


def anchors(grams: np.ndarray, width: int, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least gram of each window of `width` grams, the last of equal ones: equal windows have it at the same place.

    grams: hash of each gram; fits: for each window start, whether the window counts. Returns for each run of windows
    with one anchor: its place, the first and the last window start.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(20, len(grams).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[:n], least[width - span:width - span + n])
    at = np.flatnonzero(fits[:n])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    place = (low - (least[at] & low)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return place[first], at[first], at[last]
