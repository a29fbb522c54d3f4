"""Terms of many texts at once: runs of ASCII letters and digits and of bytes outside ASCII, A-Z lower-cased.

No byte of a character outside ASCII is below 0x80, so runs of bytes are runs of characters. A text is
read in parts that end between terms, so that the arrays of a long one stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_IN = np.zeros(256, dtype=bool)
_IN[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN[0x80:] = True
_NOT_IN = bytes(np.flatnonzero(~_IN).tolist())
#: Bytes of text that are taken apart at once.
PART_BYTES = 2 << 20


class Terms:
    """whole: all texts, lower-cased, parted by line feeds; starts, lengths: of each term; counts: terms of each text."""

    def __init__(self, texts: list[bytes]):
        self.whole = b"\n".join(texts).lower() + b"\n"
        self.buffer = np.frombuffer(self.whole, dtype=np.uint8)
        inside = _IN[self.buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.r_[0, edges]
        self.starts = edges[::2]
        self.lengths = edges[1::2] - self.starts
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.counts = np.diff(np.searchsorted(self.starts, np.r_[0, ends]))

    def listed(self) -> list[bytes]:
        whole = self.whole
        return [whole[a:b] for a, b in zip(self.starts.tolist(), (self.starts + self.lengths).tolist(), strict=True)]


def parts(text: bytes, limit: int = PART_BYTES) -> Iterator[bytes]:
    """``text`` in parts of ``limit`` bytes or, where a term does not end there, more."""
    at = 0
    while len(text) - at > limit:
        end = at + limit
        while end < len(text):
            inside = _IN[np.frombuffer(text[end : end + 65536].lower(), dtype=np.uint8)]
            if not inside.all():
                end += int(np.argmin(inside))
                break
            end += len(inside)
        yield text[at:end]
        at = end
    yield text[at:]
