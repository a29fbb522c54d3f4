"""Importance resampling of documents towards a target distribution, over hashed runs of words.

Every text becomes a row of a sparse matrix of documents by buckets: how often each bucket's features
(runs of one to ``LONGEST`` terms) stand in it. The matrix is persisted in blocks of compressed sparse rows, so a text
is read once. Column sums of the documents' and of the target's matrix are the two distributions; the
logarithm of their smoothed ratio is a bucket's gain, and the product of the matrix with the gains,
over a document's features, its weight. Gumbel noise from a hash of the key turns the highest scores into a
sample without replacement, the same however the input is split.

CRC-32 is linear: that of two joined terms is the first's, moved on by the second's length, XORed with
the second's. So features get their buckets from one checksum a term, in arrays.

Only vectors over the buckets and a histogram of scores, whose sizes no number of rows changes, reach the driver.

Defined results: a null or empty text has no features and weight 0; rows with a null key have a score of their own
(the hash of ``7:``) and come last among ties; repeated rows each get a row; a very long text is counted in parts;
an empty table of documents gives an empty table, an empty target a distribution without features; further columns
are left out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators import catalog

from . import common, terms

BUCKETS = 10_000
LONGEST = 2
SEED = 7
SHARE_PERCENT = 25
LEAST_WORDS = 20
#: Terms up to so many bytes have their checksums in step, longer ones one by one.
IN_STEP = 64
BLOCK_BYTES = 2 << 20


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()
_ONES = np.uint32(0xFFFFFFFF)


def _next(register: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(register ^ byte) & np.uint32(0xFF)] ^ (register >> np.uint32(8))


def _moves() -> np.ndarray:
    """[n, k, v]: what byte k of a checksum, of value v, comes to when n zero bytes follow."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(IN_STEP):
        now = _next(now, np.uint32(0))
        out.append(now)
    return np.stack(out)


_MOVES = _moves()


def checksums(found: terms.Terms) -> np.ndarray:
    """The unsigned CRC-32 of every term."""
    register = np.full(len(found.starts), _ONES, dtype=np.uint32)
    at = np.flatnonzero(found.lengths <= IN_STEP)
    place, left = found.starts[at], found.lengths[at]
    while len(at):
        register[at] = _next(register[at], found.buffer[place])
        more = left > 1
        at, place, left = at[more], place[more] + 1, left[more] - 1
    register ^= _ONES
    for k in np.flatnonzero(found.lengths > IN_STEP).tolist():
        register[k] = zlib.crc32(memoryview(found.whole)[found.starts[k] : found.starts[k] + found.lengths[k]])
    return register


def _joined(found: terms.Terms, heads: np.ndarray, singles: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Checksums of ``heads``, a space and the terms numbered ``last``."""
    heads = _next(heads ^ _ONES, np.uint32(0x20)) ^ _ONES
    length = found.lengths[last]
    near = np.minimum(length, IN_STEP)
    moved = np.zeros(len(heads), dtype=np.uint32)
    for k in range(4):
        moved ^= _MOVES[near, k, (heads >> np.uint32(8 * k)) & np.uint32(0xFF)]
    out = moved ^ singles[last]
    for k in np.flatnonzero(length > IN_STEP).tolist():
        start = found.starts[last[k]]
        out[k] = zlib.crc32(memoryview(found.whole)[start : start + length[k]], int(heads[k]))
    return out


def features(found: terms.Terms, longest: int = LONGEST, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the checksum of every run of terms; runs within the first ``known`` terms are left out."""
    single = checksums(found)
    owner = np.repeat(np.arange(len(found.counts)), found.counts)
    owners, sums, run = [owner[known:]], [single[known:]], single
    for n in range(2, longest + 1):
        last = np.arange(n - 1, len(single))
        run = _joined(found, run[: len(last)], single, last)
        whole = (owner[last] == owner[last - (n - 1)]) & (last >= known)
        owners.append(owner[last][whole])
        sums.append(run[whole])
    return np.concatenate(owners), np.concatenate(sums)


def _long_row(text: bytes, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """Terms and bucket counts of one long text, in parts; each takes the last terms before it along."""
    words, counts, before = 0, np.zeros(buckets, dtype=np.int64), []
    for part in terms.parts(text):
        found = terms.Terms([b" ".join([*before, part])])
        words += len(found.starts) - len(before)
        _, sums = features(found, longest, len(before))
        counts += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        listed = [found.whole[found.starts[k] : found.starts[k] + found.lengths[k]] for k in range(max(0, len(found.starts) - longest + 1), len(found.starts))]
        before = listed
    return words, counts


def _rows(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its terms and row length, and the buckets and counts of all rows."""
    if len(texts) == 1 and len(texts[0]) > terms.PART_BYTES:
        words, counts = _long_row(texts[0], buckets, longest)
        used = np.flatnonzero(counts)
        return np.array([words]), np.array([len(used)]), used, counts[used]
    found = terms.Terms(texts)
    owner, sums = features(found, longest)
    cells, counts = np.unique(owner * buckets + sums % np.uint32(buckets), return_counts=True)
    return found.counts, np.bincount(cells // buckets, minlength=len(texts)), cells % buckets, counts


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _blocks(batches, key: str, buckets: int, longest: int):
    for batch in common.slices(batches, "text", BLOCK_BYTES):
        words, sizes, columns, counts = _rows(common.text_bytes(common.column(batch, "text")), buckets, longest)
        ends = np.r_[0, np.cumsum(sizes)]
        sums = np.r_[0, np.cumsum(counts)]
        n = batch.num_rows
        whole = pa.array([0, n], pa.int32())
        listed = [pa.ListArray.from_arrays(whole, values) for values in (common.column(batch, key), pa.array(words.astype(np.int64)), pa.array(np.diff(sums[ends]).astype(np.int64)))]
        blobs = [pa.array([values.tobytes()], pa.binary()) for values in (ends.astype("<i8"), columns.astype(_kind(buckets)), counts.astype("<u4"))]
        yield pa.RecordBatch.from_arrays([*listed, *blobs], names=["keys", "n_words", "n_features", "indptr", "indices", "counts"])


def matrix(docs: DataFrame, key: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The persisted matrix of ``docs`` (key, text): a row for each block.

    keys, n_words and n_features are arrays over the block's documents; indptr (8 bytes each), indices
    (2 bytes each, or 4 from 65536 buckets on) and counts (4 bytes each) its sparse rows, little-endian.
    """
    common.ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("_key"), F.col("text").cast("string").alias("text"))
    kind = source.schema["_key"].dataType.simpleString()
    schema = f"keys array<{kind}>, n_words array<long>, n_features array<long>, indptr binary, indices binary, counts binary"
    return common.materialise(source.mapInArrow(lambda batches: _blocks(batches, "_key", buckets, longest), schema), "matrix")


def _sparse(batch: pa.RecordBatch, row: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blob = {name: common.column(batch, name)[row].as_py() for name in ("indptr", "indices", "counts") if name in batch.schema.names}
    starts = np.frombuffer(blob["indptr"], "<i8") if "indptr" in blob else None
    return starts, np.frombuffer(blob["indices"], _kind(buckets)), np.frombuffer(blob["counts"], "<u4")


def _sums(batches, buckets: int):
    sums = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            _, columns, counts = _sparse(batch, row, buckets)
            sums += np.bincount(columns, counts, buckets).astype(np.int64)  # sums of a block are exact as doubles
    used = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], names=["bucket", "n"])


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket: a vector over the buckets, summed by tasks and then by bucket."""
    found = blocks.select("indices", "counts").mapInArrow(lambda batches: _sums(batches, buckets), "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    ratios = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def _weights(batches, vector: np.ndarray):
    for batch in batches:
        for row in range(batch.num_rows):
            starts, columns, counts = _sparse(batch, row, len(vector))
            sums = np.r_[0, np.cumsum(vector[columns] * counts.astype(np.int64))]
            totals = sums[starts[1:]] - sums[starts[:-1]]
            keys, words, sizes = (common.column(batch, name)[row].values for name in ("keys", "n_words", "n_features"))
            n = sizes.to_numpy()
            weight = np.where(n > 0, totals // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([keys, words, sizes, pa.array(weight)], names=["_key", "n_words", "n_features", "weight"])


def weights(blocks: DataFrame, vector: np.ndarray, key: str) -> DataFrame:
    """key, n_words, n_features and weight of every row of the matrix: its product with ``vector``, floored by feature."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    found = blocks.mapInArrow(lambda batches: _weights(batches, vector), f"_key {kind}, n_words long, n_features long, weight long")
    return found.withColumnRenamed("_key", key)


def noise(key, seed: int = SEED):
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of SHA-256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, key: str, percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (a written table) with rank: 1, 2, ... down the drawn documents, null for the others.

    The score of the last drawn one comes from a histogram of the whole-number scores, and only
    documents from there on are sorted, over all tasks.
    """
    fit = F.col("n_words") >= least_words
    counts = sorted(scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect(), reverse=True)  # scores span some 100000 whole numbers
    drawn = percent * sum(r["n"] for r in counts) // 100
    reached, cut = 0, None
    for row in counts:
        if reached < drawn:
            reached, cut = reached + row["n"], row["score"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = fit & (F.col("score") >= cut)
    ranked = catalog.ranked(scored.where(near), F.desc("score"), F.asc_nulls_last(key), F.desc("weight"), F.desc("n_features"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row of ``docs``; ``rank`` is null unless drawn.

    ``target`` has a column text. ``percent`` of the documents with ``least_words`` terms or more are drawn.
    """
    blocks = matrix(docs, key, buckets, longest)
    wanted = matrix(target.select(F.lit(0).alias("_none"), "text"), "_none", buckets, longest)
    vector = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    scored = weights(blocks, vector, key).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return draw(common.materialise(scored, "scored"), key, percent, least_words)
