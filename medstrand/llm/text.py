"""Words and their hashes, found for many texts at once inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text whose words are found in one go; only a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# ASCII digits and letters, and every byte of a character outside ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
    WORD_BYTES[first : last + 1] = True

# Everything but the space and the control characters 9 to 13.
TOKEN_BYTES = np.ones(256, dtype=bool)
TOKEN_BYTES[[32, 9, 10, 11, 12, 13]] = False

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``, kept and lengthened as needed."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 65)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > SLICE_BYTES + 65:
            return have
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of some texts in order: byte bounds, hash, text number, and each text's first word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        data = LOWER[data]
        inside = table[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = bounds[1:-1]
            before[edges[edges < len(inside)]] = False
            after[edges[edges > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _power(_BASE, len(data)), out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        spread = (total[self.end] - total[self.start]) * _power(_INVERSE, len(data))[self.start]
        self.hash = mix(spread + length)
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(bounds) - 1), self.count)
        # Place of each word in its own text.
        self.place = np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows ``(from, to, bytes, bounds)`` of about SLICE_BYTES; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, stop, whole[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def words(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    for row, stop, data, bounds in slices(texts):
        yield row, stop, Words(data, bounds, table)


def windows(words: Words, size: int, multiplier: int = 0xD1B54A32D192ED03) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within one text, and the number of each run's first word.

    A text with fewer words, but not none, is one run of all its words.
    """
    m = np.uint64(multiplier)
    n = len(words.hash)
    reach = words.count - np.minimum(words.count, size) + 1
    reach[words.count == 0] = 0
    first = np.repeat(words.first[:-1], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    value = np.zeros(len(first), dtype=np.uint64)
    last = np.repeat(words.first[1:], reach)
    for step in range(size):
        at = first + step
        use = at < last
        term = words.hash[np.minimum(at, max(n - 1, 0))] if n else np.empty(0, np.uint64)
        value = np.where(use, value * m + term + np.uint64(1), value)
    return mix(value), first
