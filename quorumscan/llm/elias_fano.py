"""Monotone sequences in Elias-Fano form, over any buffer: bytes, an Arrow column or a memory map.

A number's lower bits are packed one after the other, its upper bits are a unary bit vector, and a count of ones at
every word of it serves selects.  All questions are asked for arrays at once.
"""

from __future__ import annotations

import numpy as np

#: Place of the k-th set bit in a byte, 8 where there is none.
IN_BYTE = np.array([[next((b for b in range(8) if (v >> b) & 1 and bin(v & ((1 << b) - 1)).count("1") == k), 8) for k in range(8)] for v in range(256)], np.uint8)
_ONE = np.uint64(1)


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word."""
    place = np.zeros(len(words), np.int64)
    k = k.copy()
    for half in (32, 16, 8):
        low = words & np.uint64((1 << half) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = k >= ones
        k -= np.where(up, ones, 0)
        place += np.where(up, half, 0)
        words = np.where(up, words >> np.uint64(half), low)
    return place + IN_BYTE[(words & np.uint64(255)).astype(np.int64), k]


class EliasFano:
    """``n`` numbers that never fall, opened over the arrays that ``parts`` made."""

    def __init__(self, head: np.ndarray, lower: np.ndarray, upper: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.low = int(head[0]), int(head[1])
        self.upper, self.ones = upper, ones
        self.zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones
        self.lower = np.ndarray((max(0, len(lower) - 7),), "<u8", lower, strides=(1,))

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        """The arrays of a sequence: numbers of it, packed lower bits, upper bits, counts of ones."""
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        lower = np.zeros((n * low + 7) // 8 + 8, np.uint8)
        for at in range(0, n if low else 0, 1 << 16):  # a multiple of eight numbers ends at a byte
            part = values[at : at + (1 << 16)]
            bits = ((part[:, None] >> np.arange(low, dtype=np.uint64)) & _ONE).astype(np.uint8)
            raw = np.packbits(bits.ravel(), bitorder="little")
            lower[at * low // 8 : at * low // 8 + len(raw)] = raw
        place = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros(((int(place[-1]) if n else 0) + 2 + 63) // 64, np.uint64)
        np.bitwise_or.at(upper, place >> 6, _ONE << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper).astype(np.int64))[:-1]]).astype(np.int64)
        return [np.array([n, low], np.int64), lower, upper, ones]

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i * self.low
        return (self.lower[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return 64 * word + _in_word(self.upper[word], i - self.ones[word])

    def _ones_before_zero(self, h: np.ndarray) -> np.ndarray:
        """How many numbers have upper bits of h or less."""
        inside = h < 64 * len(self.upper) - self.n
        h = np.where(inside, h, 0)
        word = np.searchsorted(self.zeros, h, "right") - 1
        return np.where(inside, 64 * word + _in_word(~self.upper[word], h - self.zeros[word]) - h, self.n)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        return ((self._select1(i) - i) << self.low) | self._lower(i).astype(np.int64)

    def successor(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) whose number is ``value`` or more, else ``end``.

        All places in between share the value's upper bits, so lower parts are compared, by halves.
        """
        value = np.maximum(value, 0)
        h = value >> self.low
        first = np.where(h > 0, self._ones_before_zero(np.maximum(h - 1, 0)), 0)
        place, last = np.maximum(first, begin), np.minimum(self._ones_before_zero(h), end)
        want = (value & ((1 << self.low) - 1)).astype(np.uint64)
        live = np.flatnonzero(place < last)
        while len(live):
            middle = (place[live] + last[live]) >> 1
            low = self._lower(middle) < want[live]
            place[live[low]] = middle[low] + 1
            last[live[~low]] = middle[~low]
            live = live[place[live] < last[live]]
        return np.minimum(place, end)

    def find(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) that has ``value``, else -1."""
        out = np.full(len(value), -1, np.int64)
        place = self.successor(value, begin, end)
        ask = np.flatnonzero(place < end)
        hit = ask[self.get(place[ask]) == value[ask]]
        out[hit] = place[hit]
        return out
