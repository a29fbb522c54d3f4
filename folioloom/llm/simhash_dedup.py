"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 if it is set in more than half of the XXH64 hashes (seed 42) of a text's
3-word shingles. Fingerprints link at ``RADIUS`` or fewer differing bits. Bit position i has the
vector m(i) in F2^4, and each of the 15 nonzero vectors v gives a mask that keeps the bits with
<m(i), v> = 1. Three differing bits are three equations in four unknowns, so some v drops all
of them: each linked pair agrees under at least one mask and meets in that table. No pair is missed.

Distinct fingerprints are compared, so copies cost one row. In a bucket a search from each
unvisited fingerprint emits a star per component, never all pairs. A bucket with over
``HOT_BUCKET`` fingerprints is dealt out again by the same construction over the bits that its
mask drops; what then meets agrees on all but about 14 bits, which bounds every group.

Defined results: a null or blank text has fingerprint zero, linked like any other; fewer than three
words make one shingle; rows with a null doc_id get a component but never name one (its id is null if
all its doc_ids are); repeated rows each get a row; very long texts are read whole, in memory by their number of
words; an empty table gives an empty table; further columns are left out (``deduplicate`` passes them as they are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, components

RADIUS = 3
SHINGLE = 3
SEED = 42
HOT_BUCKET = 1500


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= width:
        return [digest(whole, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return [digest(whole[s:e], SEED) for s, e in zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    if not hashes:
        return 0
    values = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(batches, passed, width):
    for batch in common.slices(batches, "text"):
        found = np.array([fingerprint(shingle_hashes(t, width)) for t in common.text_bytes(common.column(batch, "text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in passed), pa.array(found.view(np.int64))], names=[*passed, "fp"])


def fingerprints(docs: DataFrame, passed: list[str], width: int = SHINGLE) -> DataFrame:
    common.ship(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*passed, "text"]))
    return source.mapInArrow(lambda batches: _fingerprints(batches, passed, width), docs.select(*passed).schema.add("fp", "long"))


def covering_masks(bits: list[int], vectors: int = 15) -> list[int]:
    """A mask over ``bits`` for each nonzero vector of F2^4."""
    place = {bit: 1 + k % vectors for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (place[bit] & v).bit_count() % 2) for v in range(1, 16)]


MASKS = covering_masks(list(range(64)))
#: For each mask the masks of the second level, over the bits that it drops.
INNER_MASKS = [covering_masks([b for b in range(64) if not mask >> b & 1]) for mask in MASKS]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def star_edges(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning star for each component of distinct uint64 values linked within the radius."""
    values = np.sort(values)
    edges, rest = [], values
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found = rest[near]
                edges += [(root, other) for other in found]
                front += list(found)
                rest = rest[~near]
    return edges


def _bucket_edges(batches, keys, radius):
    """Rows come sorted by ``keys``; yields star edges of each run of equal keys."""
    held_key, held = None, []

    def close():
        return star_edges(np.unique(np.concatenate(held)), radius) if held else []

    def batch_of(edges):
        pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [common.column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        values = common.column(batch, "fp").to_numpy().view(np.uint64)
        change = np.zeros(len(values), dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.r_[starts[1:], len(values)]
        out = []
        if tuple(c[0] for c in columns) != held_key:
            out += close()
            held = []
        whole = ends - starts == 2
        whole[0] = whole[-1] = False  # they may go on in another batch
        left, right = values[starts[whole]], values[starts[whole] + 1]
        near = (np.bitwise_count(left ^ right) <= radius) & (left != right)
        out += list(zip(left[near], right[near], strict=True))
        last = len(starts) - 1
        for k in np.flatnonzero(~whole):
            run = values[starts[k] : ends[k]]
            if k == 0:
                held.append(run)
                if last:
                    out += close()
                    held = []
            elif k < last:
                out += star_edges(np.unique(run), radius)
            if k == last and last:
                held = [run]
        held_key = tuple(c[-1] for c in columns)
        if out:
            yield batch_of(out)
    if edges := close():
        yield batch_of(edges)


def _spread(fps: DataFrame, source: str, masks, names: list[str], passed: list[str]) -> DataFrame:
    table = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias(names[0]), F.col(source).bitwiseAND(F.lit(_signed(m))).alias(names[1])) for k, m in enumerate(masks)]))
    return fps.select(*passed, table.alias("_t")).select(*passed, "_t.*")


def links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b) edges that connect exactly the components of distinct ``fp`` values."""
    if radius > RADIUS:
        raise ValueError(f"the masks cover a radius of {RADIUS}")
    spark: SparkSession = distinct.sparkSession
    common.ship(spark)
    n = common.partitions(spark)
    rows = _spread(distinct, "fp", MASKS, ["v", "key"], ["fp"])
    sizes = common.materialise(rows.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = common.materialise(rows.join(sizes, ["v", "key"]), "met")
    small = met.where(F.col("n") <= hot).select("v", "key", "fp")
    edges = small.repartition(n, "v", "key").sortWithinPartitions("v", "key").mapInArrow(lambda batches: _bucket_edges(batches, ["v", "key"], radius), "a long, b long")
    inner = F.lit(None)
    for v, masks in enumerate(INNER_MASKS):
        inner = F.when(F.col("v") == v, F.array(*[F.struct(F.lit(k).cast("byte").alias("w"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("inner")) for k, m in enumerate(masks)])).otherwise(inner)
    large = met.where(F.col("n") > hot).select("v", "key", "fp", F.explode(inner).alias("_t")).select("v", "key", "_t.w", "_t.inner", "fp")
    keys = ["v", "key", "w", "inner"]
    more = large.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _bucket_edges(batches, keys, radius), "a long, b long")
    return edges.unionByName(more).distinct()


def named_roots(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """``nodes`` (distinct fp) with _root, the least fingerprint that links reach."""
    roots = components.connected(links(nodes.select("fp"), radius, hot))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    return common.materialise(named.select(*nodes.columns, F.coalesce("root", "fp").alias("_root")), "named")


def clusters(docs: DataFrame, key: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """key, fp (long) and component_id (the smallest key that links reach) of every row."""
    known = common.materialise(fingerprints(docs, [key], width), "fingerprints")
    named = named_roots(known.groupBy("fp").agg(F.min(key).alias("_low")), radius, hot)
    least = named.groupBy("_root").agg(F.min("_low").alias("component_id"))
    component = named.join(least, "_root").select("fp", "component_id")
    return known.join(component, "fp").select(key, "fp", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """``docs`` with one row of each component: that of the least key, known keys first.

    Among rows of that key and fingerprint the one with the least hash of the row stays. Texts are not
    written aside: they are fingerprinted again as they are read for the result.
    """
    docs, names, restored = common.guarded(docs, key, "text")
    mark = [F.col(key).isNull().alias("_null"), F.coalesce(F.col(key), F.lit(0)).alias("_key")]
    known = common.materialise(fingerprints(docs, [key], width).select(*mark, "fp"), "fingerprints")
    # one row of each fingerprint before components are joined: copies weigh nothing there
    first = common.materialise(known.groupBy("fp").agg(F.min(F.struct("_null", "_key")).alias("_first")), "distinct")
    named = named_roots(first.select("fp"), radius, hot)
    stay = first.join(named, "fp").groupBy("_root").agg(F.min(F.struct("_first", "fp")).alias("_row")).select("_row._first._null", "_row._first._key", "_row.fp")
    whole = fingerprints(docs, names, width).select(*names, *mark, "fp")
    joined = whole.join(stay, ["_null", "_key", "fp"], "left_semi")
    place = F.row_number().over(Window.partitionBy("_null", "_key", "fp").orderBy(F.xxhash64(*names)))
    return restored(joined.withColumn("_place", place).where("_place = 1"))


def fingerprint_hex(fp):
    """16 lowercase hex digits of a fingerprint held as a long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
