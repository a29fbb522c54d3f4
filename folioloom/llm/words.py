"""Words of many texts at once, and a compact table from words to numbers.

Words are runs of bytes other than ASCII white space. They are found in one buffer of all texts, and
each gets a 128-bit key, made of its length and its bytes eight at a time, so that a table of words
needs no object a word: it is an open-addressing hash table in arrays, some 30 bytes a word.
"""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

#: Bytes of a word from which xxh3 makes its key; shorter ones are keyed in step.
LONG = 256
_PAD = b"\n" + bytes(8)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_TERM = np.uint64(0x165667B19E3779F9)


class Words:
    """buffer: all texts, parted by line feeds; starts, lengths: of each word; counts: words of each text."""

    def __init__(self, texts: list[bytes]):
        self.whole = b"\n".join(texts) + _PAD
        self.buffer = np.frombuffer(self.whole, dtype=np.uint8)
        space = _IS_SPACE[self.buffer[: -len(_PAD) + 1]]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.r_[0, edge]
        self.starts = edge[::2]
        self.lengths = edge[1::2] - self.starts
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        bounds = np.searchsorted(self.starts, np.r_[0, np.cumsum(sizes)])
        self.counts = np.diff(bounds)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return keys(self.whole, self.buffer, self.starts, self.lengths)

    def word(self, k: int) -> bytes:
        return self.whole[self.starts[k] : self.starts[k] + self.lengths[k]]

    def picked(self, places: np.ndarray) -> list[bytes]:
        whole = self.whole
        starts = self.starts[places]
        return [whole[a:b] for a, b in zip(starts.tolist(), (starts + self.lengths[places]).tolist(), strict=True)]


def keys(whole: bytes, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each word's key; ``buffer`` has eight bytes more than the words need."""
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))
    a, b = lengths.astype(np.uint64), lengths.astype(np.uint64) + _TERM
    at, place, left = None, starts, lengths
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        at = np.flatnonzero(lengths <= LONG)
        place, left = starts[at], lengths[at]
    while len(place):
        chunk = eight[place] & _MASKS[np.minimum(left, 8)]
        x, y = (a, b) if at is None else (a[at], b[at])
        x = (x ^ chunk) * _FACTORS[0]
        x ^= x >> np.uint64(29)
        y = (y + chunk) * _FACTORS[1]
        y ^= y >> np.uint64(31)
        if at is None:
            a, b = x, y
        else:
            a[at], b[at] = x, y
        more = np.flatnonzero(left > 8)
        at, place, left = more if at is None else at[more], place[more] + 8, left[more] - 8
    a = (a ^ (a >> np.uint64(32))) * _FACTORS[1]
    a ^= a >> np.uint64(32)
    for k in long.tolist():
        digest = xxhash.xxh3_128_intdigest(memoryview(whole)[starts[k] : starts[k] + lengths[k]])
        a[k], b[k] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
    return a, b


def keys_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    whole = b"".join(words) + _PAD
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return keys(whole, np.frombuffer(whole, np.uint8), np.cumsum(lengths) - lengths, lengths)


def first_of_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of equal keys, and for each key the number of its place among these."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    fresh = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if len(a) else np.zeros(0, bool)
    number = np.empty(len(a), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


class Table:
    """Keys to the numbers 0, 1, ... in the order in which they were added."""

    def __init__(self, bits: int = 12):
        self.size = 0
        self.a, self.b = np.zeros(1 << bits >> 1, np.uint64), np.zeros(1 << bits >> 1, np.uint64)
        self.place = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of keys, -1 for those that are not there."""
        mask = np.uint64(len(self.place) - 1)
        at = a & mask
        out = self.place[at]
        wrong = np.flatnonzero((out >= 0) & ((self.a[out] != a) | (self.b[out] != b)))
        at, a, b = at[wrong], a[wrong], b[wrong]
        while len(wrong):  # on to the next place, in step
            at = (at + np.uint64(1)) & mask
            found = self.place[at]
            out[wrong] = found
            left = np.flatnonzero((found >= 0) & ((self.a[found] != a) | (self.b[found] != b)))
            wrong, at, a, b = wrong[left], at[left], a[left], b[left]
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of new keys, which must be distinct and not be there yet."""
        n = self.size + len(a)
        numbers = np.arange(self.size, n, dtype=np.int32)
        if n > len(self.a):
            room = 1 << max(12, int(n).bit_length())
            self.a, self.b = (np.concatenate([x[: self.size], np.zeros(room - self.size, np.uint64)]) for x in (self.a, self.b))
            self.a[self.size : n], self.b[self.size : n] = a, b
            self.place = np.full(2 * room, -1, dtype=np.int32)
            self._put(self.a[:n], np.arange(n, dtype=np.int32))
        else:
            self.a[self.size : n], self.b[self.size : n] = a, b
            self._put(a, numbers)
        self.size = n
        return numbers

    def _put(self, a: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.place) - 1)
        spot = a & mask
        while len(numbers):
            free = self.place[spot] < 0
            self.place[spot[free]] = numbers[free]
            left = self.place[spot] != numbers
            spot, numbers = (spot[left] + np.uint64(1)) & mask, numbers[left]


class Lists:
    """A list of numbers for each word of a table, in arrays."""

    def __init__(self, kind=np.int32):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.table = Table()
        self.used = 0
        self.values = np.zeros(1024, dtype=self.kind)
        self.start = np.zeros(1024, dtype=np.int32)
        self.length = np.zeros(1024, dtype=np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table.find(a, b)

    def add(self, a: np.ndarray, b: np.ndarray, values: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of words that are new to the table, whose lists stand in a row."""
        numbers = self.table.add(a, b)
        if self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(len(self.values) // 2 + len(values), self.kind)])
        if self.table.size > len(self.start):
            more = np.zeros(len(self.start) // 2 + len(a), np.int32)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        self.values[self.used : self.used + len(values)] = values
        own = slice(self.table.size - len(a), self.table.size)
        self.start[own] = self.used + np.cumsum(length) - length
        self.length[own] = length
        self.used += len(values)
        return numbers

    def values_of(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of numbered words in a row."""
        return self.values[common.ragged(self.start[numbers].astype(np.int64), self.length[numbers])]
