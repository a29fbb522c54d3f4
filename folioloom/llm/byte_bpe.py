"""Byte-level BPE of texts by a transducer, and streaming decoding of ids back to text.

The merges of a rank file (a token's rank is its id; of all adjacent pairs whose bytes together are a token, the
one of the least rank merges first, the leftmost of equals) are compiled into a finite-state transducer:

* A row of tokens is an encoding exactly if each adjacent pair is one of its own two (``Merges.stand``): no merge across
  their border comes before the merges within them. So of all tokens that end at a place, exactly one may follow the
  encoding of the text before it.
* A state holds the places at which a token that is still being read may have begun: where it is in the trie of
  tokens, the token before it, and the tokens on the way there that are not emitted yet. Reading a byte moves all of
  them, ends one token, and emits what all that are left have in common. No place is held longer than the longest token,
  which bounds the lookahead.
* States are made when they are first reached, and each (state, byte) once. A full table is emptied.

A token whose own bytes merge into others is reachable only as a whole match, which libraries look up first, and
so does this module. If a token's parts have higher ranks than itself, the pairwise rule does not hold: the
vocabulary is then encoded by its merges, step by step (``Merges.run``).

No match of the splitting pattern goes on after a space or a line feed between two characters that are no white space
(``Encoder``), so texts are cut there without the pattern, and each distinct unit is split and encoded once
while it is in a worker's store, of bounded size. Decoding takes ids in chunks: an incremental UTF-8 machine holds the bytes of an unfinished character back for the next chunk.

Defined results: a null or empty text has no ids and decodes to nothing; a match of any length takes time in proportion
to it; a very long text is split and decoded in chunks, though its ids are one row; bytes that are not UTF-8 are read as
U+FFFD; special tokens' strings are ordinary text; repeated rows and null keys are rows like others; an empty table
gives an empty table; further columns pass if named. Ids outside the vocabulary fail when decoded.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Units kept a worker, and the most characters of one that is kept; states and judged pairs of tokens.
STORE_PIECES, STORE_CHARS, MOST_STATES, MOST_PAIRS = 300_000, 48, 300_000, 400_000
#: Matches, and ids, taken at once of one text.
CHUNK = 1 << 16
ID = np.dtype("<u4")
#: White space but for the space and the line feed: in ASCII, and all of it.
_ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_SPACE = _ASCII_SPACE + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Merges:
    """Merges of a vocabulary, and whether two tokens stand beside each other in an encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary needs all 256 bytes")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ordered = True  # so far no token's parts have higher ranks than itself
        self._sides: dict[int, tuple[list, list] | None] = {}
        self._pairs: dict[int, bool] = {}

    def run(self, piece: bytes, seen=None) -> list[int]:
        """The encoding by merges: a heap of adjacent pairs over a linked list. ``seen`` hears of each merge's ends and rank."""
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n

        def pair(k):
            if (m := after[k]) < n and end[m] - k <= self.longest:
                return self.ranks.get(piece[k : end[m]])

        waiting = [(r, k, end[after[k]]) for k in range(n) if (r := pair(k)) is not None]
        heapify(waiting)
        while waiting:
            rank, k, stop = heappop(waiting)
            m = after[k] if alive[k] else n
            if m >= n or end[m] != stop:
                continue
            if seen:
                seen(k, m, stop, rank)
            alive[m], end[k], after[k] = False, stop, after[m]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and (r := pair(left)) is not None:
                    heappush(waiting, (r, left, end[after[left]]))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[piece[k : end[k]]])
            k = after[k]
        return out

    def sides(self, token: int):
        """What a token's first and last part is in turn while it is merged, with the rank of the merge that ends it
        (first parts, last parts); None if its bytes merge into others."""
        if token not in self._sides:
            text = self.tokens[token]
            first, last = [(text[:1], _NEVER)], [(text[-1:], _NEVER)]
            highest: dict[int, int] = {}

            def seen(k, m, stop, rank):
                highest[k] = max(rank, highest.get(k, -1), highest.get(m, -1))
                if highest[k] != rank:
                    self.ordered = False
                for whole, parts in ((k == 0, first), (stop == len(text), last)):
                    if whole:
                        parts[-1] = (parts[-1][0], rank)
                        parts.append((text[k:stop], _NEVER))

            self._sides[token] = (first, last) if self.run(text, seen) == [token] else None
        return self._sides[token]

    def stand(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` (-1: the beginning) are encoded as these two."""
        if a < 0:
            return self.sides(b) is not None
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > MOST_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._judged(a, b)
        return known

    def _judged(self, a: int, b: int) -> bool:
        if self.sides(a) is None or self.sides(b) is None:
            return False
        lasts, firsts = self.sides(a)[1], self.sides(b)[0]
        i = j = 0
        while True:
            (left, left_ends), (right, right_ends) = lasts[i], firsts[j]
            across = self.ranks.get(left + right, _NEVER)
            # of equal ranks the leftmost merges first: within a, across, within b
            if across < left_ends and across <= right_ends:
                return False
            if left_ends == right_ends == _NEVER:
                return True
            if left_ends <= right_ends:
                i += 1
            else:
                j += 1


class Transducer:
    """bytes of a match to ids; states are made when they are reached."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.next: dict[int, int] = {}  # node and byte to node
        self.token = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(self.token)
                    self.token.append(-1)
                node = self.next[key]
            self.token[node] = rank
        inside = {key >> 8 for key in self.next}
        self.inner = [node in inside for node in range(len(self.token))]  # whether tokens go on from a node
        self.clear()

    def clear(self) -> None:
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.moves: dict[int, int] = {}  # state and byte to the state after it and the number of what is emitted
        self.emitted: list[tuple[int, ...]] = [()]
        self.emission: dict[tuple[int, ...], int] = {(): 0}
        self.final: list[tuple[int, ...]] = []  # what a match that ends in a state still emits
        self.start = self._state([(0, -1, ())])

    def _state(self, places: list[tuple]) -> int:
        """The number of a state, which is kept in few bytes: for each place node, token before, how many held back, and these."""
        flat = []
        for node, last, held in places:
            flat += (node, last, len(held), *held)
        packed = array("i", flat).tobytes()
        number = self.number.setdefault(packed, len(self.states))
        if number == len(self.states):
            self.states.append(packed)
            self.final.append(places[-1][2])
        return number

    def places(self, state: int) -> list[tuple[int, int, tuple[int, ...]]]:
        flat = array("i", self.states[state]).tolist()
        out, at = [], 0
        while at < len(flat):
            end = at + 3 + flat[at + 2]
            out.append((flat[at], flat[at + 1], tuple(flat[at + 3 : end])))
            at = end
        return out

    def _move(self, state: int, byte: int) -> int:
        """The state after a byte, and the number of what is emitted. A place is (node, token before it, tokens held back)."""
        go, tokens, inner, stand = self.next.get, self.token, self.inner, self.merges.stand
        places, ended = [], None
        for node, last, held in self.places(state):
            child = go(node << 8 | byte)
            if child is not None:
                if ended is None and tokens[child] >= 0 and stand(last, tokens[child]):
                    ended = (tokens[child], (*held, tokens[child]))
                if inner[child]:
                    places.append((child, last, held))
        if ended is None:
            raise LookupError("no token ends here")
        token, held = ended
        out = ()
        if not places:
            places, out = [(0, token, ())], held
        elif not places[0][2]:  # the oldest place holds nothing back: nothing is common
            places.append((0, token, held))
        else:
            common = 0
            for own in zip(held, *(place[2] for place in places)):  # noqa: B905 as far as the shortest goes
                if own.count(own[0]) != len(own):
                    break
                common += 1
            places = [(node, last, kept[common:]) for node, last, kept in places]
            places.append((0, token, held[common:]))
            out = held[:common]
        number = self.emission.setdefault(out, len(self.emitted))
        if number == len(self.emitted):
            self.emitted.append(out)
        found = self.moves[state << 8 | byte] = self._state(places) << 32 | number
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.merges.ranks.get(piece)
        if whole is not None:
            return [whole]
        if self.merges.ordered:
            if len(self.states) > MOST_STATES:
                self.clear()
            out, state, moves, emitted = [], self.start, self.moves, self.emitted
            try:
                for byte in piece:
                    found = moves.get(state << 8 | byte)
                    if found is None:
                        if len(self.states) > 2 * MOST_STATES:  # within a long match: the state is taken along
                            places = self.places(state)
                            self.clear()
                            state, moves, emitted = self._state(places), self.moves, self.emitted
                        found = self._move(state, byte)
                    state = found >> 32
                    if found & 0xFFFFFFFF:
                        out += emitted[found & 0xFFFFFFFF]
            except LookupError:
                if self.merges.ordered:
                    raise
            if self.merges.ordered:
                return [*out, *self.final[state]]
        return self.merges.run(piece)


class Store(dict):
    """Units to their ids as bytes; what is missing is made. When it is full, it becomes the older of two generations:
    what is still asked for is taken over from there, the rest goes with it.

    A unit that ends in a letter or digit and one of ``signs`` is the unit before it and the sign, and is not kept."""

    def __init__(self, make, signs: dict[str, bytes]):
        super().__init__()
        self.make, self.signs = make, signs
        self.older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > 1 and unit[-1] in self.signs and unit[-2].isalnum():
            return self[unit[:-1]] + self.signs[unit[-1]]
        ids = self.older.get(unit)
        if ids is None:
            ids = self.make(unit)
        if len(unit) <= STORE_CHARS:
            if len(self) >= STORE_PIECES:
                self.older = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class Encoder:
    """Texts to ids.

    With ``units``, for patterns like the public one, a text is cut before each space, and around each line feed, that
    stands between two characters that are no white space: there a match ends and another begins, as a space can only
    be the first character of a match that is not all white space, and a line feed one of its own. So what
    lies between (``words``: with the space before it; ``heads``: at the beginning of a line) is split alike
    wherever it stands. Texts with other white space are split by the pattern.
    """

    #: The patterns for which this holds.
    UNITS = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.units = pattern in self.UNITS
        self.loose = regex.compile(r"\s[ \n]|[ \n]\s|^[ \n]|[ \n]\Z")
        signs = {sign: self._ids(sign) for sign in ".,;:!?"} if self.units else {}
        self.words, self.heads = Store(lambda unit: self._split(" " + unit), signs), Store(self._split, signs)

    def _is_loose(self, text: str) -> bool:
        """Whether white space stands beside a space or line feed, or one of these at an end."""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return True
        return any(sign in text for sign in (_ASCII_SPACE if text.isascii() else _SPACE)) and self.loose.search(text) is not None

    def _ids(self, piece: str) -> bytes:
        return array("I", self.transducer.encode(piece.encode())).tobytes()

    def _split(self, unit: str) -> bytes:
        pieces = self.pattern.findall(unit)
        if len(pieces) == 1:
            return self._ids(unit)
        return b"".join([self.words[p[1:]] if len(p) > 1 and p[0] == " " and p[1] != " " else self.heads[p] for p in pieces])

    def ids(self, text: str) -> bytes:
        if self.units and text and not self._is_loose(text):
            known, head = self.words.__getitem__, self.heads
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(head[first] + b"".join(map(known, rest)))
            return head["\n"].join(lines)
        found = (m[0] for m in self.pattern.finditer(text))
        chunks = []
        while part := list(islice(found, CHUNK)):
            chunks.append(b"".join(map(self._kept, part)))
        return b"".join(chunks)

    def _kept(self, piece: str) -> bytes:
        return self.heads[piece]


def _utf8_machine() -> list[list[int]]:
    """[state][byte] to state: 0 a whole character, 1 to 3 so many bytes to come, 4 to 7 the second byte after E0, ED, F0
    and F4, which is restricted, 8 malformed."""
    table = [[8] * 256 for _ in range(9)]
    ranges = [
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEF, 2), (0, 0xED, 0xED, 5), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7),
        (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ]
    for state, low, high, then in ranges:
        table[state][low : high + 1] = [then] * (high + 1 - low)
    return table


_UTF8 = _utf8_machine()


class Utf8Stream:
    """Bytes in chunks to text: an unfinished character waits for the next chunk; malformed bytes become U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        cut = len(data)
        for start in range(len(data) - 1, max(-1, len(data) - 4), -1):
            if data[start] & 0xC0 != 0x80:  # the last byte that can begin a character
                state = 0
                for byte in data[start:]:
                    state = _UTF8[state][byte]
                if 0 < state < 8:
                    cut = start
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in ranks.items()}

    def chunks(self, ids: Iterable[np.ndarray]) -> Iterator[bytes]:
        for part in ids:
            yield b"".join(map(self.tokens.__getitem__, part.tolist()))

    def stream(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of each chunk of ids, as far as its characters are whole."""
        machine = Utf8Stream()
        for chunk in self.chunks(ids):
            yield machine.feed(chunk)
        yield machine.finish()


_TOOLS: dict[tuple, object] = {}


def _tool(kind, *which):
    if (kind, *which) not in _TOOLS:
        _TOOLS[(kind, *which)] = kind(*which)
    return _TOOLS[(kind, *which)]


def _encoded(batches, path: str, pattern: str, passed: list[str]):
    tool = _tool(Encoder, path, pattern)
    for batch in common.slices(batches, "_text", 1 << 20):
        gc.disable()  # the tables hold no cycles, and would be walked through again and again
        try:
            ids = [tool.ids(t.decode("utf-8", "replace")) for t in common.text_bytes(common.column(batch, "_text"))]
        finally:
            gc.enable()
        yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in passed), pa.array([len(i) // ID.itemsize for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*passed, "n_tokens", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, passed: list[str]) -> DataFrame:
    """``passed`` columns, n_tokens and ids (little-endian, four bytes each) of every row's ``text``."""
    common.ship(docs.sparkSession)
    source = docs.select(*passed, F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(lambda batches: _encoded(batches, path, pattern, passed), docs.select(*passed).schema.add("n_tokens", "long").add("ids", "binary"))


def _decoded(batches, path: str, passed: list[str]):
    tool = _tool(Decoder, path)
    for batch in common.slices(batches, "_ids", 2 << 20):
        raw, texts = [], []
        for ids in common.column(batch, "_ids").to_pylist():
            values = np.frombuffer(ids or b"", ID)
            machine, own, text = Utf8Stream(), [], []
            for chunk in tool.chunks(values[k : k + CHUNK] for k in range(0, len(values), CHUNK)):
                own.append(chunk)
                text.append(machine.feed(chunk))
            raw.append(b"".join(own))
            texts.append("".join([*text, machine.finish()]))
        yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in passed), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], names=[*passed, "decoded", "text"])


def decode(tokens: DataFrame, path: str, passed: list[str]) -> DataFrame:
    """``passed`` columns, the bytes of every row's ``ids`` as decoded, and as text, malformed bytes replaced."""
    common.ship(tokens.sparkSession)
    source = tokens.select(*passed, F.col("ids").alias("_ids"))
    return source.mapInArrow(lambda batches: _decoded(batches, path, passed), tokens.select(*passed).schema.add("decoded", "binary").add("text", "string"))


def round_trip(docs: DataFrame, path: str, pattern: str, passed: list[str]) -> DataFrame:
    """``encode`` and, of its ids, ``decode``, in one pass over the rows: ``passed`` columns, n_tokens, ids, decoded, text."""
    common.ship(docs.sparkSession)
    source = docs.select(*passed, F.col("text").cast("string").alias("_text"))

    def run(batches):
        for ids in _encoded(batches, path, pattern, passed):
            for back in _decoded([ids.append_column("_ids", common.column(ids, "ids"))], path, [*passed, "n_tokens", "ids"]):
                yield back

    schema = docs.select(*passed).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "binary").add("text", "string")
    return source.mapInArrow(run, schema)
