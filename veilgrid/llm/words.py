"""Words of an Arrow string column as NumPy arrays: places and 64-bit hashes, without a Python loop over words.

A word is a run of bytes that a table marks; A-Z are lower-cased first. Bytes of 0x80 and more are either all
word bytes or not, so working on UTF-8 gives the same words as working on characters. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPAN = 1 << 18  # bytes hashed at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space (0x20, 0x09-0x0D) parts.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, letters a-z and everything beyond ASCII, after lower-casing.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Values of bytes by their place in a span, the first 64 places; each is random, so no pattern of letters cancels out.
_NEAR = 64
_LETTER = mix(np.arange(1, 257, dtype=np.uint64))
_PLACED = mix(_LETTER[None, :] + mix(np.arange(1, _NEAR + 1, dtype=np.uint64))[:, None]).ravel()


def _placed(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The value of each byte at its place."""
    out = _PLACED[(np.minimum(place, _NEAR - 1) << 8) | data]
    far = np.flatnonzero(place >= _NEAR)
    out[far] = mix(_LETTER[data[far]] + mix(place[far].astype(np.uint64) + np.uint64(1)))
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, one row at least."""
    _, offsets = column_bytes(column)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: the sum of a random value for each byte and place. Spans are in order and do not overlap.

    A polynomial modulo 2 ** 64 would give different words of some patterns (Thue-Morse) one hash at any base.
    """
    opens, closes = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.uint64)
    before = np.uint64(0)
    for low in range(int(start[0]), int(end[-1]), _SPAN) if len(start) else ():
        high = min(low + _SPAN, int(end[-1]))
        first, last = int(np.searchsorted(start, low, side="right")) - 1, int(np.searchsorted(start, high))
        origin = start[first:last]
        place = np.arange(low, high) - np.repeat(origin, np.diff(np.append(np.maximum(origin, low), high)))
        sums = np.empty(high - low + 1, dtype=np.uint64)
        sums[0] = before
        np.cumsum(_placed(data[low:high], place), out=sums[1:])
        sums[1:] += before
        a, b = np.searchsorted(start, (low, high))
        opens[a:b] = sums[start[a:b] - low]
        a, b = np.searchsorted(end, (low, high), side="right")
        closes[a:b] = sums[end[a:b] - low]
        before = sums[-1]
    return mix(closes - opens)


class Words:
    """Words of some rows: ``start`` and ``end`` bytes in ``data``, ``hash``, and ``first``: n + 1 word offsets of rows."""

    def __init__(self, column: pa.Array, letters: np.ndarray):
        raw, offsets = column_bytes(column)
        self.data = LOWER[raw]
        inside = letters[self.data]
        opens, closes = inside.copy(), inside.copy()
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[edges] = inside[edges]  # rows do not share words
        closes[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hashes(self.data, self.start, self.end)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words, and hashes, of all windows of ``length`` consecutive words of one row."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        total = np.zeros(n - length + 1, dtype=np.uint64)
        for k in range(length):
            total *= _BASE
            total += self.hash[k: n - length + 1 + k]
        whole = np.ones(n - length + 1, dtype=bool)
        for edge in np.unique(self.first[1:-1]):
            whole[max(0, edge - length + 1): edge] = False
        at = np.flatnonzero(whole)
        return at, mix(total[at])

    def windows_of_row(self, row: int) -> np.int64:
        """The hash of the one window that all words of a row make."""
        total = np.zeros(1, dtype=np.uint64)
        for h in self.hash[self.first[row]: self.first[row + 1]]:
            total *= _BASE
            total += h
        return mix(total).view(np.int64)[0]

    def text(self, at: int, length: int) -> bytes:
        """``length`` words from word ``at`` on, parted by blanks."""
        data = self.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.start[at: at + length], self.end[at: at + length], strict=True))
