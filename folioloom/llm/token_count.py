"""Token counts under a unigram model, by dynamic programming over a trie.

A pre-token is a run of characters other than ASCII white space, preceded by the vocabulary's
word mark. Its tokens are the segmentation into vocabulary pieces with the greatest sum of piece
scores (fewest tokens on a tie). The distinct new pre-tokens of a slice of texts are inserted in a trie, which is
built level by level; the forward score of a node is computed once, for all pre-tokens with that prefix, and all nodes
of a level are computed in step. The node at which a pre-token ends has its count, which is kept for
further occurrences. Pre-tokens of over ``LONG`` characters are scored one by one, with the last scores at hand.

The supplied piece vocabulary has merge ranks, not probabilities, so a piece of rank r gets the
Zipf score ``-log((r + 1) * H)``, H normalising. A character in no piece costs as many
byte tokens as UTF-8 gives it, each scored ``BYTE_PENALTY`` under the lowest piece.

Defined results: a null or empty text has no pre-token and no token; repeated rows each get
a row; the doc_id passes as it is, null too; a very long text is cut at no place, and takes memory by its
number of words, not by their lengths; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

MARK = "▁"
BYTE_PENALTY = 10.0
#: Pre-tokens whose counts a worker keeps; the store is emptied when it is full. It bounds memory, not results.
STORE_WORDS = 1_500_000
#: Characters of a pre-token, mark included, up to which it goes into a trie.
LONG = 64


def load_scores(path: str) -> dict[str, float]:
    """Piece -> score, from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {piece: -math.log(rank + 1) - norm for rank, piece in enumerate(pieces)}


_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Pieces:
    """Piece scores by two polynomial hashes of the characters, which those of prefixes give for any substring."""

    def __init__(self, scores: dict[str, float]):
        self.longest = max(map(len, scores), default=1)
        self.powers = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.longest, base)]) for base in _BASES]
        self.table, self.score = words.Table(), np.zeros(len(scores))
        by_length: dict[int, list[str]] = {}
        for piece in scores:
            by_length.setdefault(len(piece), []).append(piece)
        for length, own in by_length.items():
            points = np.array([[ord(c) for c in piece] for piece in own], dtype=np.uint64) + np.uint64(1)
            sums = [np.zeros(len(own), np.uint64) for _ in _BASES]
            for k in range(length):
                sums = [h * base + points[:, k] for h, base in zip(sums, _BASES, strict=True)]
            self.score[self.table.add(*map(_mixed, sums))] = [scores[p] for p in own]

    def find(self, now: list[np.ndarray], before: list[np.ndarray], length: int) -> np.ndarray:
        """Numbers of the pieces that are the last ``length`` characters of prefixes, -1 where there is none."""
        return self.table.find(*(_mixed(h - g * power[length]) for h, g, power in zip(now, before, self.powers, strict=True)))


class CountTrie:
    """Counts of pre-tokens, which a trie of the new ones gives."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.pieces = Pieces(scores)
        self.longest = self.pieces.longest
        self.byte_score = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.nodes = 0  # of all tries so far
        self.clear()

    def clear(self) -> None:
        self.table, self.count = words.Table(), np.zeros(1024, dtype=np.int32)

    def long_count(self, text: str) -> int:
        """By the recurrence itself; only as many scores as the longest piece has characters are held."""
        last = deque([(0.0, 0)], self.longest)
        for at, char in enumerate(text, 1):
            best, fewest = -math.inf, 0
            for length in range(1, min(at, self.longest) + 1):
                piece = self.scores.get(text[at - length : at])
                if piece is not None:
                    value, many = last[-length][0] + piece, last[-length][1] + 1
                    if value > best or value == best and many < fewest:
                        best, fewest = value, many
            if char not in self.scores:
                n = len(char.encode("utf-8", "surrogatepass"))
                value, many = last[-1][0] + n * self.byte_score, last[-1][1] + n
                if value > best or value == best and many < fewest:
                    best, fewest = value, many
            last.append((best, fewest))
        return last[-1][1]

    def trie_counts(self, texts: list[str]) -> np.ndarray:
        """Counts of distinct texts that are in order and none of which is over ``LONG`` characters."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        depth = int(lengths.max())
        points = np.zeros((depth, n), dtype=np.uint64)  # 0 beyond the end, else the code point and 1
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(n), lengths)
        points[np.arange(len(flat)) - (np.cumsum(lengths) - lengths)[owner], owner] = flat + np.uint64(1)
        shared = np.zeros(n, dtype=np.int64)  # characters that a text has in common with the one before
        alike = np.ones(n - 1, dtype=bool)
        for level in range(depth):
            alike &= points[level, 1:] == points[level, :-1]
            shared[1:] += alike
        hashes = [[np.zeros(n, np.uint64)] for _ in _BASES]
        score, count = [np.zeros(n)], [np.zeros(n, np.int32)]
        out = np.zeros(n, dtype=np.int64)
        for level in range(1, depth + 1):
            for own, base in zip(hashes, _BASES, strict=True):
                own.append(own[-1] * base + points[level - 1])
            fresh = (lengths >= level) & (shared < level)
            node = np.flatnonzero(fresh)  # a text that has this node first stands for it
            self.nodes += len(node)
            now = [own[level][node] for own in hashes]
            best, fewest = np.full(len(node), -np.inf), np.zeros(len(node), np.int32)
            for length in range(1, min(level, self.longest) + 1):
                found = self.pieces.find(now, [own[level - length][node] for own in hashes], length)
                known = found >= 0
                if length == 1:
                    single = known
                value = np.where(known, score[level - length][node] + self.pieces.score[found], -np.inf)
                many = count[level - length][node] + 1
                better = (value > best) | (value == best) & (many < fewest)
                best, fewest = np.where(better, value, best), np.where(better, many, fewest)
            char = points[level - 1, node] - np.uint64(1)
            size = 1 + (char >= 0x80).astype(np.int32) + (char >= 0x800) + (char >= 0x10000)
            value, many = score[level - 1][node] + size * self.byte_score, count[level - 1][node] + size
            better = ~single & ((value > best) | (value == best) & (many < fewest))
            best, fewest = np.where(better, value, best), np.where(better, many, fewest)
            place = np.maximum(np.cumsum(fresh) - 1, 0)
            score.append(best[place] if len(node) else np.zeros(n))
            count.append(fewest[place] if len(node) else np.zeros(n, np.int32))
            if level >= self.longest:  # what no piece reaches back to
                score[level - self.longest] = count[level - self.longest] = None
                for own in hashes:
                    own[level - self.longest] = None
            ends = lengths == level
            out[ends] = count[level][ends]
        return out

    def new_counts(self, found: list[bytes]) -> np.ndarray:
        texts = [MARK + word.decode("utf-8", "replace") for word in found]
        out = np.zeros(len(texts), dtype=np.int64)
        short = sorted({t for t in texts if len(t) <= LONG})
        counts = dict(zip(short, self.trie_counts(short).tolist(), strict=True)) if short else {}
        for k, text in enumerate(texts):
            out[k] = counts[text] if len(text) <= LONG else self.long_count(text)
        return out

    def counts(self, found: words.Words) -> np.ndarray:
        """Tokens of each of the words."""
        if self.table.size > STORE_WORDS:
            self.clear()
        a, b = found.keys()
        at = self.table.find(a, b)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            first, place = words.first_of_each(a[unknown], b[unknown])
            new = unknown[first]
            numbers = self.table.add(a[new], b[new])
            if self.table.size > len(self.count):
                self.count = np.concatenate([self.count, np.zeros(len(self.count) // 2 + len(new), np.int32)])
            self.count[numbers] = self.new_counts(found.picked(new))
            at[unknown] = numbers[place]
        return self.count[at].astype(np.int64)


_TRIES: dict[str, CountTrie] = {}


def _count(batches, path: str, id_column: str):
    if path not in _TRIES:
        _TRIES[path] = CountTrie(load_scores(path))
    trie = _TRIES[path]
    for batch in common.slices(batches, "text", 2 << 20):
        found = words.Words(common.text_bytes(common.column(batch, "text")))
        sums = np.r_[0, np.cumsum(trie.counts(found))]
        ends = np.cumsum(found.counts)
        yield pa.RecordBatch.from_arrays([common.column(batch, id_column), pa.array(found.counts), pa.array(sums[ends] - sums[ends - found.counts])], names=[id_column, "n_pretokens", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id") -> DataFrame:
    """id, n_pretokens, n_tokens of every row; texts stay where they are read (no shuffle)."""
    common.ship(docs.sparkSession)
    schema = docs.select(id_column).schema.add("n_pretokens", "long").add("n_tokens", "long")
    return docs.select(F.col(id_column), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _count(batches, vocabulary_path, id_column), schema)
