"""Simple-8b word-aligned integer coding with blocks, vectorised.

Each 64-bit word has a selector in its top four bits and a fixed number of equally wide values
below. Selector 15 is an escape: the next word holds one value of more than 60 bits.
Blocks of BLOCK values are coded on their own; their word offsets allow decoding any part.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the format: (values in a word, bits of each), by selector; selector 0 is a run of 240 zeros.
LAYOUT = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (1, 60), (0, 0)]
ESCAPE = 15
COUNTS = np.array([count for count, _ in LAYOUT], dtype=np.int64)
_STEPS = np.array([max(count, 1) for count, _ in LAYOUT], dtype=np.int64)
_NARROW = np.array([k.bit_length() for k in range(1 << 16)], dtype=np.uint8)
_POWERS = np.array([1 << k for k in range(64)], dtype=np.uint64)


def _widths(values: np.ndarray) -> np.ndarray:
    if len(values) and int(values.max()) < len(_NARROW):
        return _NARROW[values.astype(np.int64)]
    return np.searchsorted(_POWERS, values, side="right").astype(np.uint8)


def _choices(width: np.ndarray) -> np.ndarray:
    """For each place the selector that holds most of the values from there to its block's end."""
    choice = np.full(width.shape, ESCAPE, dtype=np.uint8)
    choice[width <= 60] = 14
    for selector in range(13, -1, -1):  # later passes hold more values and win
        count, bits = LAYOUT[selector]
        run, length = width <= bits, 1  # all of ``length`` values from here fit
        while length < count and run.any():
            more = min(length, count - length)
            run[:, :-more] &= run[:, more:].copy()
            run[:, width.shape[1] - more :] = False
            length += more
        if length < count:
            break  # no run of narrower values can be longer than one of these
        choice[run] = selector
    return choice


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and the word offset of each block, with the total at the end."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    width = np.full(-(-n // BLOCK) * BLOCK, 255, dtype=np.uint8)
    width[:n] = _widths(values)
    choice = _choices(width.reshape(-1, BLOCK)).reshape(-1)[:n]
    step = _STEPS[choice]
    starts = np.zeros(n, dtype=bool)
    here = np.arange(0, n, BLOCK)
    end = np.minimum(here + BLOCK, n)
    while len(here):  # all blocks advance together
        starts[here] = True
        here = here + step[here]
        live = here < end
        if not live.all():
            here, end = here[live], end[live]
    first = np.flatnonzero(starts)
    chosen = choice[first]
    taken = np.where(chosen == ESCAPE, 2, 1)
    slot = np.cumsum(taken) - taken
    words = np.zeros(int(taken.sum()), dtype=np.uint64)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        count, bits = LAYOUT[selector]
        head = np.uint64(int(selector) << 60)
        if selector == ESCAPE:
            words[slot[mine]] = head
            words[slot[mine] + 1] = values[first[mine]]
            continue
        packed = np.full(len(mine), head, dtype=np.uint64)
        if bits:
            at = first[mine]
            for k in range(count):
                packed |= values[at + k] << np.uint64(k * bits)
        words[slot[mine]] = packed
    blocks = np.searchsorted(first, np.arange(0, n, BLOCK))
    return words, np.r_[slot[blocks], len(words)]


def decode(words: np.ndarray) -> np.ndarray:
    """The values of whole blocks."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, dtype=bool)
    for k in np.flatnonzero(selector == ESCAPE):
        if not raw[k]:
            raw[k + 1] = True
    raw = raw[:-1]
    selector[raw] = -1
    count = np.where(raw, 1, COUNTS[selector])
    offset = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    out[offset[raw]] = words[raw]
    for s in np.unique(selector):
        if s in (-1, ESCAPE) or LAYOUT[s][1] == 0:
            continue
        many, bits = LAYOUT[s]
        mine = np.flatnonzero(selector == s)
        place, word = offset[mine], words[mine]
        for k in range(many):
            out[place + k] = (word >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out
