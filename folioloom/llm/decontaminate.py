"""Benchmark decontamination: documents that hold a passage like a benchmark item.

Words are runs between ASCII white space, lower-cased, of which only letters and digits count
(empty ones are skipped); in scripts that put no spaces between words each character is a word. A window of a document has as many words as the item it is held against,
and the SimHash of its five-word shingles. Items of each size are indexed by the eight bytes
of their fingerprints: two fingerprints within ``RADIUS`` bits agree in some byte but for at most
``RADIUS // 8`` bits, so looking up each byte among the values that near to an item's finds every
item within the radius. What is found is verified by the exact similarity of the shingle
multisets, sum of lesser over sum of greater counts, of ``SIMILARITY`` at least.

A window that similar has most shingles of its item, so only windows around a shingle of some
item are fingerprinted; this loses none. Words that no item holds have numbers of their own like others: were
they one word, a run of them would be one shingle many times over and turn the window's fingerprint.

The benchmark is read in parts of about ``PART_BYTES`` bytes, each broadcast in a pass of its own, of which the
result is written before the next, so it may be of any size; documents are never shuffled.

Defined results: an item of fewer than five words is one shingle, so it is matched as a whole; items without a
word (and null ones) match nothing; null texts hold no passage, and a text holds none of an item with more words than
it has; of windows equally like an item the first counts; repeated rows each get their rows; very long texts
are read whole; empty tables give an empty result; further columns are left out, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
PART_BYTES = 16 << 20
#: Words whose numbers a worker keeps; the store is emptied when it is full.
STORE_WORDS = 1_000_000
#: Pairs of a window and an item that are looked up at once.
PAIRS = 1 << 22
_NEAR_BYTES = np.array([[(a ^ b).bit_count() <= RADIUS // 8 for b in range(256)] for a in range(256)])
#: Scripts that put no spaces between words; each of their characters is a word.
SPACELESS = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
_PARTS = re.compile(f"[{SPACELESS}]|[^{SPACELESS}]+")


def plain(word: bytes) -> list[str]:
    """The words of a run between white space: one or none, but in scripts without spaces."""
    own = word.decode("utf-8", "replace").lower()
    if not own.isalnum():
        own = "".join(c for c in own if c.isalnum())
    return [own] if own.isascii() and own else _PARTS.findall(own)


def words_of(text: str | None) -> list[str]:
    return [w for run in (text or "").encode("utf-8", "surrogatepass").split() for w in plain(run)]


def shingle_codes(ids: np.ndarray, width: int = SHINGLE, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word numbers, or of those that begin ``at``."""
    n = max(0, len(ids) - width + 1)
    code = np.full(n if at is None else len(at), 0x243F6A8885A308D3, dtype=np.uint64)
    for k in range(width if len(code) else 0):
        code = (code ^ (ids[k : k + n] if at is None else ids[at + k]).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return code


def _bits(codes: np.ndarray) -> np.ndarray:
    """1 or -1 for each of the 64 bits of each shingle's hash."""
    return np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of shingles: sum of lesser counts over sum of greater counts."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(place[: len(a)], minlength=len(values))
    y = np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Index:
    """Items of a part of the benchmark: vocabulary, shingles and fingerprints by size."""

    def __init__(self, items: list[tuple[int, str]], floor: float = SIMILARITY):
        self.floor = floor
        self.vocabulary: dict[str, int] = {}
        by_size: dict[int, list] = {}
        shingle_sizes: dict[int, set[int]] = {}
        #: words of a short item -> code of the whole -> items
        self.short: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            numbers = np.array([self.number(w) for w in words_of(text)], dtype=np.int64)
            if not len(numbers):
                continue
            codes = shingle_codes(numbers, min(SHINGLE, len(numbers)))
            if len(numbers) < SHINGLE:
                self.short.setdefault(len(numbers), {}).setdefault(int(codes[0]), []).append(item_id)
                continue
            by_size.setdefault(len(numbers), []).append((item_id, codes))
            for code in codes.tolist():
                shingle_sizes.setdefault(code, set()).add(len(numbers))
        self.codes = np.array(sorted(shingle_sizes), dtype=np.uint64)
        self.sizes_of = [sorted(shingle_sizes[c]) for c in self.codes.tolist()]
        self.by_size = {size: self._table(found) for size, found in by_size.items()}
        self.store = words.Lists(np.int64)

    def __getstate__(self):
        return self.__dict__ | {"store": words.Lists(np.int64)}

    def number(self, word: str) -> int:
        """Word numbers are hashes, so that equal words of any part agree; odd for words of the part."""
        return self.vocabulary.setdefault(word, self.hash(word) | 1)

    @staticmethod
    def hash(word: str) -> int:
        """An even number below 2^62."""
        return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 3 << 1

    @staticmethod
    def _table(found):
        prints = np.stack([_pack(_bits(codes).sum(axis=0, keepdims=True))[0] for _, codes in found])
        near = np.stack([_NEAR_BYTES[:, prints[:, b]] for b in range(8)])  # byte place, value, item
        return [item for item, _ in found], [codes for _, codes in found], prints, near

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words in a row, even for a word of no item, and where each text's begin and end."""
        if self.store.table.size > STORE_WORDS or self.store.used > 4 * STORE_WORDS:
            self.store.clear()
        found = words.Words(texts)
        a, b = found.keys()
        at = self.store.find(a, b)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            first, place = words.first_of_each(a[unknown], b[unknown])
            new = unknown[first]
            lists = [[self.vocabulary.get(w) or self.hash(w) for w in plain(run)] for run in found.picked(new)]
            length = np.fromiter(map(len, lists), np.int64, len(lists))
            at[unknown] = self.store.add(a[new], b[new], np.array([n for own in lists for n in own], dtype=np.int64), length)[place]
        sums = np.r_[0, np.cumsum(self.store.length[at])]
        return self.store.values_of(at), sums[np.r_[0, np.cumsum(found.counts)]]

    def search(self, texts: list[bytes]) -> list[list[tuple[int, float, int, int]]]:
        """For each text its items: (item_id, similarity, first word, words) of the best window."""
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        if not self.vocabulary or not texts:
            return out
        numbers, bounds = self.numbers(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        known = numbers & 1 == 1
        for width, items in self.short.items():
            at = self._known(known, row, width)
            codes = shingle_codes(numbers, width, at)
            for k in np.flatnonzero(np.isin(codes, np.array(list(items), dtype=np.uint64))).tolist():
                text = int(row[at[k]])
                have = {hit[0] for hit in out[text]}
                out[text] += [(item, 1.0, int(at[k] - bounds[text]), width) for item in items[int(codes[k])] if item not in have]
        if len(self.codes):
            at = self._known(known, row, SHINGLE)
            code = shingle_codes(numbers, SHINGLE, at)
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[place] == code
            at, place = at[hit], place[hit]
            for k in np.unique(row[at]).tolist():
                mine = slice(*np.searchsorted(row[at], [k, k + 1]).tolist())
                out[k] += self._windows(numbers[bounds[k] : bounds[k + 1]], at[mine] - bounds[k], place[mine])
        return [sorted(hits) for hits in out]

    @staticmethod
    def _known(known: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
        """Places from which ``width`` words of items stand within one text."""
        n = len(known) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        full = row[:n] == row[width - 1 :]
        for k in range(width):
            full &= known[k : k + n]
        return np.flatnonzero(full)

    def _windows(self, numbers, hits, places):
        codes = shingle_codes(numbers)
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(codes), axis=0, dtype=np.int32)])
        wanted: dict[int, list[int]] = {}
        for at, place in zip(hits.tolist(), places.tolist(), strict=True):
            for size in self.sizes_of[place]:
                wanted.setdefault(size, []).append(at)
        best: dict[int, tuple[float, int, int]] = {}
        for size, found in wanted.items():
            span = size - SHINGLE + 1
            # the starts of windows that hold one of the shingles
            found = np.array(found)
            edge = np.zeros(len(numbers) + 2, dtype=np.int64)
            np.add.at(edge, np.maximum(found - span + 1, 0), 1)
            np.add.at(edge, found + 1, -1)
            first = np.flatnonzero(np.cumsum(edge)[: max(0, len(numbers) - size + 1)])
            items, item_codes, prints, near = self.by_size[size]
            step = max(1, PAIRS // len(items))
            for low in range(0, len(first), step):
                part = first[low : low + step]
                windows = _pack(sums[part + span] - sums[part])
                candidate = near[0][windows[:, 0]]
                for b in range(1, 8):
                    candidate |= near[b][windows[:, b]]
                w, i = np.nonzero(candidate)
                close = np.bitwise_count(windows[w] ^ prints[i]).sum(axis=1) <= RADIUS
                for a, b in zip(part[w[close]].tolist(), i[close].tolist(), strict=True):
                    value = similarity(codes[a : a + span], item_codes[b])
                    if value >= self.floor and (items[b] not in best or value > best[items[b]][0]):
                        best[items[b]] = (value, a, size)
        return [(item, *found) for item, found in best.items()]


def parts(benchmark: DataFrame, limit: int = PART_BYTES) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in lists of about ``limit`` bytes, brought to the driver one by one, and whether each is the last."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        yield sorted((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()), k == n - 1


def _search(batches, held, passed):
    names = [*passed, "item_id", "similarity", "first_word", "n_words"]
    for batch in common.slices(batches, "text", 2 << 20):
        found = held.value.search(common.text_bytes(common.column(batch, "text")))
        rows = [(k, *hit) for k, hits in enumerate(found) for hit in hits]
        if rows:
            place, item, value, first, size = (list(x) for x in zip(*rows, strict=True))
            take = pa.array(place)
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c).take(take) for c in passed), pa.array(item, pa.int64()), pa.array(value, pa.float64()), pa.array(first, pa.int64()), pa.array(size, pa.int32())], names=names)


def passages(docs: DataFrame, benchmark: DataFrame, passed: list[str], floor: float = SIMILARITY) -> DataFrame:
    """A row for each document row and item that it holds a passage of, with the best window."""
    spark = docs.sparkSession
    common.ship(spark)
    inside = [f"_in{k}" for k in range(len(passed))]
    schema = docs.select(*[F.col(c).alias(i) for c, i in zip(passed, inside, strict=True)]).schema
    schema = schema.add("item_id", "long").add("similarity", "double").add("first_word", "long").add("n_words", "integer")
    source = docs.select(*[F.col(c).alias(i) for c, i in zip(passed, inside, strict=True)], F.col("text").alias("text"))
    out = None
    for items, last in parts(benchmark):
        held = spark.sparkContext.broadcast(Index(items, floor))
        found = source.mapInArrow(lambda batches, held=held: _search(batches, held, inside), schema)
        if not (last and out is None):  # a pass at once, so that one part is held at a time
            found = common.materialise(found, "passages")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out.toDF(*passed, "item_id", "similarity", "first_word", "n_words")


def _clean(batches, held):
    for batch in common.slices(batches, "text", 2 << 20):
        found = held.value.search(common.text_bytes(common.column(batch, "text")))
        yield batch.filter(pa.array([not hits for hits in found]))


def clean(docs: DataFrame, benchmark: DataFrame, floor: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no passage, as they are."""
    spark = docs.sparkSession
    common.ship(spark)
    for items, last in parts(benchmark):
        held = spark.sparkContext.broadcast(Index(items, floor))
        docs = docs.mapInArrow(lambda batches, held=held: _clean(batches, held), docs.schema)
        if not last:
            docs = common.materialise(docs, "clean")
            held.destroy()
    return docs
