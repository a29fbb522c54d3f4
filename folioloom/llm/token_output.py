"""Token ids to a binary file format and back.

Texts are encoded with a public tokenizer file, in ascending doc_id order, and written as a
table of segments. A segment is a self-contained binary record: a header, the documents' ids and
lengths, the word offset of every Simple-8b block and the coded words. ``seq`` and ``base``
(ids before the segment within its shard) order the segments; shards are ordered by number.
Spark's commit protocol writes the table, so a lost executor leaves no torn file.

Defined results: a null text is empty and has the end id alone; null doc_ids come first;
rows that share a doc_id follow in the order of their texts' hash; a very long text is one document of
one segment, however large; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simple8b, words

MAGIC = b"FL8B"
#: Ids after which a segment is closed (a document is never cut).
SEGMENT_IDS = 1 << 18
#: Words, and ids of words, kept per worker; the store is emptied when it is full. Some 60 bytes a word.
STORE_WORDS, STORE_IDS = 1_500_000, 6_000_000
SIGNS = frozenset(b"%c" % sign for sign in b".,!?;:")
HEADER = struct.Struct("<4sIQII")
SEGMENT_SCHEMA = "shard int, seq int, base long, n_ids long, payload binary"


class WordEncoder:
    """Encodes texts by encoding each distinct word once, while it is in the store (arrays, see ``words``).

    The tokenizer replaces white space by word boundaries and no step of it reads across one, so
    the ids of a text are those of its words (split at ASCII white space) in a row. It lower-cases,
    and cuts a word before a sign that follows a letter, so a word's ids are those of its
    lower-cased stem and of its last sign. Stems of letters alone are encoded many at a time: each
    is one run of ids, which ends with the only piece of it that ends a word.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends_word[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        #: of ids on their way: two bytes where all ids fit
        self.id_kind = id_kind(max([end_id, *vocabulary.values()]))
        self.store = words.Lists()

    def encode_each(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in found], add_special_tokens=False)]
        return np.array([i for ids in lists for i in ids], dtype=np.int32), np.fromiter(map(len, lists), np.int64, len(lists))

    def encode_stems(self, stems: list[bytes], at_once: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for k in range(0, len(stems), at_once):
            part = stems[k : k + at_once]
            [found] = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            own = np.array(found.ids, dtype=np.int32)
            ends = np.flatnonzero(self.ends_word[own])
            if len(ends) == len(part) and ends[-1] == len(own) - 1:
                own, length = own, np.diff(ends, prepend=-1)
            else:
                own, length = self.encode_each(part)
            ids.append(own)
            lengths.append(length)
        return np.concatenate(ids), np.concatenate(lengths)

    def numbers(self, found: list[bytes], encode) -> np.ndarray:
        """Store numbers of distinct words, encoding those that are not there."""
        a, b = words.keys_of(found)
        out = self.store.find(a, b)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.store.add(a[new], b[new], *encode([found[k] for k in new.tolist()]))
        return out

    def learn(self, found: list[bytes]) -> None:
        """Put distinct words that are not in the store there."""
        joined, plain, other = [], [], []
        for word in found:
            stem, sign = word, b""
            if not word.isalpha() and word[-1:] in SIGNS and len(word) > 1:
                stem, sign = word[:-1], word[-1:]
            if stem.isalpha():  # ASCII letters
                stem = stem.lower()
            else:
                text = stem.decode("utf-8", "replace")
                low = text.lower()
                if not text.isalpha() or not low.isalpha() or "Σ" in text:  # whose lower case depends on its place
                    other.append(word)
                    continue
                stem = low.encode()
            if stem == word:
                plain.append(word)
            else:
                joined.append((word, stem, sign))
        stems = list(dict.fromkeys([*plain, *(stem for _, stem, _ in joined)]))
        if stems:
            place = dict(zip(stems, self.numbers(stems, self.encode_stems).tolist(), strict=True))
        signs = list({sign for _, _, sign in joined if sign})
        if signs:
            of_sign = dict(zip(signs, self.numbers(signs, self.encode_each).tolist(), strict=True))
        if other:
            self.numbers(other, self.encode_each)
        if joined:
            parts = np.array([(place[stem], of_sign[sign] if sign else -1) for _, stem, sign in joined], dtype=np.int64)
            pairs = parts.reshape(-1)[parts.reshape(-1) >= 0]
            length = self.store.length[parts[:, 0]] + np.where(parts[:, 1] >= 0, self.store.length[parts[:, 1]], 0)
            a, b = words.keys_of([word for word, _, _ in joined])
            self.store.add(a, b, self.store.values_of(pairs), length)

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Store numbers of all texts' words in a row, and each text's count of ids with its end id."""
        if self.store.table.size > STORE_WORDS or self.store.used > STORE_IDS:
            self.store.clear()
        found = words.Words(texts)
        a, b = found.keys()
        numbers = self.store.find(a, b)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            first, _ = words.first_of_each(a[unknown], b[unknown])
            self.learn(found.picked(unknown[np.sort(first)]))
            numbers[unknown] = self.store.find(a[unknown], b[unknown])
        lengths = self.store.length[numbers].astype(np.int64)
        sums = np.r_[0, np.cumsum(lengths)]
        ends = np.cumsum(found.counts)
        return numbers, sums[ends] - sums[ends - found.counts] + 1

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by the end id, and their counts."""
        numbers, per_text = self.look_up(texts)
        out = np.full(int(per_text.sum()), self.end_id, dtype=np.int32)
        word_ids = np.ones(len(out), dtype=bool)
        word_ids[np.cumsum(per_text) - 1] = False
        out[word_ids] = self.store.values_of(numbers)
        return out, per_text


def id_kind(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    return b"".join(
        [
            HEADER.pack(MAGIC, 1, len(ids), len(doc_ids), len(offsets) - 1),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            known.tobytes(),
            counts.astype("<u8").tobytes(),
            offsets.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, counts, block offsets and words of a segment."""
    magic, version, n_ids, n_docs, n_blocks = HEADER.unpack_from(payload)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment")
    at = HEADER.size
    doc_ids = np.frombuffer(payload, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    known = np.frombuffer(payload, np.uint8, n_docs, at)
    at += n_docs
    counts = np.frombuffer(payload, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    offsets = np.frombuffer(payload, "<u8", n_blocks + 1, at).astype(np.int64)
    at += 8 * (n_blocks + 1)
    words = np.frombuffer(payload, "<u8", -1, at)
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], counts, offsets, words


def read_range(payload: bytes, low: int, high: int) -> np.ndarray:
    """Ids ``low .. high - 1`` of a segment, decoding only the blocks that hold them."""
    _, _, offsets, words = unpack(payload)
    if high <= low:
        return np.zeros(0, np.uint64)
    first, last = low // simple8b.BLOCK, (high - 1) // simple8b.BLOCK
    values = simple8b.decode(words[offsets[first] : offsets[last + 1]])
    return values[low - first * simple8b.BLOCK : high - first * simple8b.BLOCK]


def _write(batches, path: str, end_id: int):
    from pyspark import TaskContext

    tool, shard = encoder(path, end_id), TaskContext.get().partitionId()
    doc_ids, counts, ids, held, seq, base = [], [], [], 0, 0, 0

    def segment():
        nonlocal doc_ids, counts, ids, held, seq, base
        row = pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([base], pa.int64()), pa.array([held], pa.int64()), pa.array([pack(doc_ids, np.concatenate(counts), np.concatenate(ids))], pa.binary())],
            names=["shard", "seq", "base", "n_ids", "payload"],
        )
        doc_ids, counts, ids, base, held, seq = [], [], [], base + held, 0, seq + 1
        return row

    for batch in common.slices(batches, "text", 1 << 20):
        found, per_text = tool.encode(common.text_bytes(common.column(batch, "text")))
        doc_ids += common.column(batch, "doc_id").to_pylist()
        counts.append(per_text)
        ids.append(found)
        held += len(found)
        if held >= SEGMENT_IDS:
            yield segment()
    if doc_ids:
        yield segment()


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> str:
    """Encode ``docs`` (doc_id, text) and write the segments under ``folder``; returns it."""
    spark = docs.sparkSession
    common.ship(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(lambda batches: _write(batches, tokenizer_path, end_id), SEGMENT_SCHEMA).write.parquet(folder)
    return folder


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            doc_ids, counts, _, words = unpack(row["payload"])
            ids = simple8b.decode(words).astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(row["base"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "_start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    common.ship(spark)
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(folder)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # as many rows as shards
    before = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    rows = files.mapInArrow(_read, "doc_id long, shard int, _start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def _counted(batches, path: str, end_id: int, passed: list[str]):
    tool = encoder(path, end_id)
    for batch in common.slices(batches, "text", 1 << 20):
        counts = tool.look_up(common.text_bytes(common.column(batch, "text")))[1]
        yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in passed), pa.array(counts)], names=[*passed, "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, passed: list[str], end_id: int = 2) -> DataFrame:
    """``passed`` columns and n_tokens, end id included, of every row."""
    common.ship(docs.sparkSession)
    source = docs.select(*passed, F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda batches: _counted(batches, tokenizer_path, end_id, passed), docs.select(*passed).schema.add("n_tokens", "long"))


def _pieces(batches, path: str, end_id: int, most: int):
    tool = encoder(path, end_id)
    for batch in common.slices(batches, "text", 1 << 20):
        ids, counts = tool.encode(common.text_bytes(common.column(batch, "text")))
        many = -(-counts // most)
        owner = np.repeat(np.arange(len(counts)), many)
        piece = common.ragged(np.zeros(len(many), np.int64), many)
        start = (np.cumsum(counts) - counts)[owner] + piece * most
        size = np.minimum(counts[owner] - piece * most, most)
        own = [ids[a : a + n].astype(tool.id_kind).tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([common.column(batch, "_key").take(pa.array(owner)), pa.array(piece), pa.array(size), pa.array(own, pa.binary())], names=["_key", "piece", "n_tokens", "ids"])


def token_pieces(docs: DataFrame, tokenizer_path: str, key: str, most: int, end_id: int = 2) -> DataFrame:
    """_key (the key as a long), piece, n_tokens and the ids (of two or four bytes each) of each piece of ``most`` ids at most."""
    common.ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("_key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda batches: _pieces(batches, tokenizer_path, end_id, most), "_key long, piece long, n_tokens long, ids binary")


def token_folder(spark) -> str:
    return f"{common.root(spark)}/tokens-{uuid.uuid4().hex}"
