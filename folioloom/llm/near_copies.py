"""Near copies by exact five-word similarity, with candidates from SimHash fingerprints and from MinHash bands.

A text's words are runs between ASCII white space with A-Z lower-cased; its shingles are the set of its
runs of ``SHINGLE`` words (a shorter text is one shingle). Texts link if their sets have a Jaccard similarity of
``SIMILARITY`` or more. Candidates come from two tables, and each is verified on the sets of 64-bit shingle hashes:

* SimHash, as in ``simhash_dedup``: fingerprints at three or fewer differing bits meet under a covering mask, each of them. That
  meets texts that are alike almost all through. At a similarity of 0.8 about ten of 64 bits differ, and masks
  that cover so many bits are too many, so others need a second table.
* MinHash bands: ``ROWS`` of the ``BANDS * ROWS`` least values of the shingles under as many
  permutations. A pair at similarity s agrees in no band with probability (1 - s^5)^30: 7 in a million at
  0.8, less above.

Equal word sequences count as one text. A bucket of at most ``SMALL`` texts gives all its pairs, a larger
one a star from the text that most others meet. Once these are verified, a larger bucket whose texts are not yet in one
component has the pairs across components compared in its task as well, but for those whose ``BANDS * ROWS`` least values rule
0.8 out by five standard deviations. So a large group of near copies costs a star, while a bucket of many texts
alike below 0.8 costs its pairs (compared in blocks; only links become rows).

Defined results: null and blank texts are copies of each other; known keys stay before null ones, then the least
key of a component stays; of rows with that key and words the one with the least hash of the row; of equal rows
one. Very long texts are read whole; an empty table gives an empty table; further columns pass as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import common, components, simhash_dedup, unspaced

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 5
SMALL = 8
#: Equal least values, of 150, that a pair at 0.8 falls short of once in some million times.
LEAST_EQUAL = 95
BLOCK = 256
_RANDOM = np.random.default_rng(20240501)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words_hash(text: bytes) -> int:
    """Of the word sequence; equal for equal sequences only, but for chance."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7)


def shingles(text: bytes) -> np.ndarray:
    return np.unique(np.array(simhash_dedup.shingle_hashes(unspaced.spaced(text), SHINGLE), dtype=np.uint64))


def least_values(found: np.ndarray) -> np.ndarray:
    """Least values of a nonempty set under each permutation."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        part = found[at : at + 512, None] * _FACTORS + _TERMS
        # high bits depend on all bits of the hash
        np.minimum(out, (part ^ (part >> np.uint64(32))).min(axis=0), out=out)
    return out


def band_values(least: np.ndarray) -> list[int]:
    table = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(table)]


def bands(found: np.ndarray) -> list[int]:
    return band_values(least_values(found))


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _once(batches, seen):
    """Rows whose digest ``_t`` was not seen in this task."""
    for batch in batches:
        own = common.column(batch, "_t").to_pylist()
        fresh = [k for k, t in enumerate(own) if t not in seen and not seen.add(t)]
        yield batch.take(pa.array(fresh, pa.int64()))


def _hashes(batches, passed, make, once=False, prints=False):
    for batch in common.slices(_once(batches, set()) if once else batches, "text"):
        texts = common.text_bytes(common.column(batch, "text"))
        arrays, names = [common.column(batch, c) for c in passed] + [_signed([words_hash(t) for t in texts])], [*passed, "h"]
        if prints:
            arrays, names = [*arrays, _signed([simhash_dedup.fingerprint(simhash_dedup.shingle_hashes(t)) for t in texts])], [*names, "fp"]
        if make:
            lists = [make(found) if len(found) else [] for found in map(shingles, texts)]
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32))
            flat = np.concatenate([np.asarray(x, dtype=np.uint64) for x in lists])
            arrays, names = [*arrays, pa.ListArray.from_arrays(offsets, _signed(flat))], [*names, "list"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def hashed(docs: DataFrame, passed: list[str], make=None, once: bool = False, prints: bool = False) -> DataFrame:
    """``passed`` columns, h (the hash of the word sequence) and, with ``make``, what it makes of the shingles.

    With ``prints`` fp, the SimHash fingerprint, comes too. With ``once``, rows of one ``_t`` (a digest of the row) come once a task.
    """
    source = docs.select(*dict.fromkeys([*passed, "text"]))
    schema = docs.select(*passed).schema.add("h", "long")
    if prints:
        schema = schema.add("fp", "long")
    return source.mapInArrow(lambda batches: _hashes(batches, passed, make, once, prints), schema.add("list", ArrayType(LongType())) if make else schema)


def alike(a: np.ndarray, b: np.ndarray, floor: float = SIMILARITY) -> bool:
    """Whether two sets of hashes, each in order, are ``floor`` alike or more."""
    least = floor - 1e-9  # a similarity of just 0.8 counts, however it is rounded
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared)


def _across(batches):
    """Rows come sorted by band; yields links of different components, each in the first band that both texts share.

    In an earlier band that both share they are compared as well: there, or as a pair of a small bucket. Likely
    pairs are verified here, and only if no links found before connect them, so no more links come out than texts came in.
    """
    held: list[pa.RecordBatch] = []

    def links_of(rows):
        table = pa.Table.from_batches(rows)
        h, roots, band = table["h"].to_numpy(), table["root"].to_numpy(), table["band"][0].as_py()
        prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint8).reshape(len(h), -1)
        shared = np.frombuffer(b"".join(table["all"].to_pylist()), np.int64).reshape(len(h), -1)
        sets = [np.frombuffer(own, np.uint64) for own in table["set"].to_pylist()]
        _, group = np.unique(roots, return_inverse=True)
        parent = list(range(len(h)))  # of groups

        def find(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        out = []
        for at in range(0, len(h), BLOCK):
            near = np.zeros((min(BLOCK, len(h) - at), len(h) - at), dtype=np.int16)
            for column in range(prints.shape[1]):
                near += prints[at : at + BLOCK, column, None] == prints[None, at:, column]
            x, y = np.nonzero((near >= LEAST_EQUAL) & (roots[at : at + BLOCK, None] != roots[None, at:]))
            x, y = at + x, at + y
            for low in range(0, len(x), 1 << 16):
                part = slice(low, low + (1 << 16))
                first = shared[x[part], (shared[x[part]] == shared[y[part]]).argmax(axis=1)] == band
                for i, j in zip(x[part][first].tolist(), y[part][first].tolist(), strict=True):
                    p, q = find(group[i]), find(group[j])
                    if p != q and alike(sets[i], sets[j]):
                        parent[p] = q
                        out.append((min(h[i], h[j]), max(h[i], h[j])))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        values = common.column(batch, "band").to_numpy()
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if held and common.column(held[0], "band")[0].as_py() != values[low]:
                yield from links_of(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield from links_of(held)


def _prints(batches):
    """Of each text the low bytes of its least values, its bands, and its set in order."""
    for batch in batches:
        sets = [np.sort(np.array(x, dtype=np.int64).view(np.uint64)) for x in common.column(batch, "list").to_pylist()]
        found = [least_values(own) for own in sets]
        columns = [[v.astype(np.uint8).tobytes() for v in found], [np.array(band_values(v), dtype=np.uint64).tobytes() for v in found], [own.tobytes() for own in sets]]
        yield pa.RecordBatch.from_arrays([common.column(batch, "h"), *(pa.array(c, pa.binary()) for c in columns)], names=["h", "print", "all", "set"])


def candidates(banded: DataFrame, small: int = SMALL) -> DataFrame:
    """(band, a, b) of distinct (band, h) rows, a < b: all pairs of small buckets, a star (with its band) of others.

    The middle of a star is the text that meets most others in large buckets. So the buckets of one group of near
    copies mostly have the same middle, and their stars the same pairs.
    """
    sizes = common.materialise(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    sized = common.materialise(banded.join(sizes, "band"), "banded")
    own = Window.partitionBy("band").orderBy("h")
    ahead = F.array(*[F.lead("h", k).over(own) for k in range(1, small)])
    met = sized.where(F.col("n") <= small).select(F.col("h").alias("a"), F.filter(ahead, lambda x: x.isNotNull()).alias("_b"))
    near = met.select(F.lit(None).cast("long").alias("band"), "a", F.explode("_b").alias("b"))
    large = sized.where(F.col("n") > small)
    weights = common.materialise(large.groupBy("h").agg(F.sum("n").alias("w")), "weights")
    middles = large.join(weights, "h").groupBy("band").agg(F.max(F.struct("w", "h"))["h"].alias("_middle"))
    star = large.join(common.materialise(middles, "middles"), "band").where("h <> _middle").select("band", F.least("_middle", "h").alias("a"), F.greatest("_middle", "h").alias("b"))
    return near.unionByName(star)


def print_pairs(texts: DataFrame) -> DataFrame:
    """(a, b), a < b, of distinct (h, fp) rows: edges that connect all texts whose SimHash fingerprints link.

    Texts of one fingerprint are a star around the least of them, which stands for all where fingerprints differ.
    """
    low = common.materialise(texts.groupBy("fp").agg(F.min("h").alias("low")), "prints")
    equal = texts.join(low, "fp").where("h <> low").select(F.col("low").alias("a"), F.col("h").alias("b"))
    side = lambda c: low.select(F.col("fp").alias(c), F.col("low").alias(f"_{c}"))
    near = simhash_dedup.links(low.select("fp")).join(side("a"), "a").join(side("b"), "b")
    return equal.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def similar(pairs: DataFrame, sets: DataFrame, floor: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets are ``floor`` alike or more."""
    side = lambda c: sets.select(F.col("h").alias(c), F.col("list").alias(f"_{c}"))
    shared = F.size(F.array_intersect("_a", "_b"))
    sizes = F.size("_a") + F.size("_b")
    least = floor - 1e-9  # a similarity of just 0.8 counts, however it is rounded
    fit = F.least(F.size("_a"), F.size("_b")) >= F.lit(least) * F.greatest(F.size("_a"), F.size("_b"))
    alike = F.when(fit, shared >= F.lit(least) * (sizes - shared)).otherwise(False)
    return pairs.join(side("b"), "b").join(side("a"), "a").where(alike).select("a", "b")


def _mark(key: str) -> list[Column]:
    return [F.col(key).isNull().alias("_null"), F.coalesce(F.col(key), F.lit(0)).alias("_key")]


def links(docs: DataFrame, texts: DataFrame, key: str, small: int = SMALL) -> DataFrame:
    """(a, b) word hashes whose components are those of all similar texts; ``texts`` has a row for each h, with its fp and its bands."""
    banded = texts.select("h", F.explode("list").alias("band"))
    met = common.materialise(candidates(banded, small), "met")
    pairs = common.materialise(print_pairs(texts.select("h", "fp")).unionByName(met.select("a", "b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    wanted = texts.select("_null", "_key", "h").join(ids, "h", "left_semi")
    rows = hashed(docs.select(*_mark(key), "text"), ["_null", "_key", "text"]).join(wanted, ["_null", "_key", "h"], "left_semi")
    sets = hashed(rows, ["_key"], lambda found: found).groupBy("h").agg(F.first("list").alias("list"))
    sets = common.materialise(sets, "sets")
    first = common.materialise(similar(pairs, sets), "similar")
    # larger buckets of several components
    large = met.where("band is not null")
    members = large.select("band", F.col("b").alias("h")).unionByName(large.select("band", F.col("a").alias("h"))).distinct()
    roots = components.connected(first)
    rooted = members.join(roots, members["h"] == roots["node"], "left").select("band", "h", F.coalesce("root", "h").alias("root"))
    rooted = common.materialise(rooted, "large")
    mixed = common.materialise(rooted.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("band"), "mixed")
    left = common.materialise(rooted.join(mixed, "band"), "left")
    prints = sets.join(left.select("h").distinct(), "h", "left_semi").mapInArrow(_prints, "h long, print binary, all binary, set binary")
    n = common.partitions(docs.sparkSession)
    rows = left.join(prints, "h").select("band", "h", "root", "print", "all", "set").repartition(n, "band").sortWithinPartitions("band", "h")
    more = common.materialise(rows.mapInArrow(_across, "a long, b long").distinct(), "across")
    return first.unionByName(more).distinct()


def deduplicate(docs: DataFrame, key: str = "doc_id", small: int = SMALL) -> DataFrame:
    """``docs`` with one row of each component: that of the least key, known keys first."""
    common.ship(docs.sparkSession)
    docs, names, restored = common.guarded(docs, key, "text")
    docs = docs.withColumn("_t", F.xxhash64(*names))
    known = hashed(docs, [key, "_t"], bands, prints=True).select(*_mark(key), "_t", "h", "fp", "list")
    # one row of each text before anything else: copies weigh nothing there
    texts = known.groupBy("h").agg(F.min(F.struct("_null", "_key", "_t")).alias("_first"), F.first("fp").alias("fp"), F.first("list").alias("list"))
    texts = common.materialise(texts.select("_first.*", "h", "fp", "list"), "texts")
    roots = components.connected(links(docs, texts, key, small))
    named = texts.join(roots, texts["h"] == roots["node"], "left").select("_null", "_key", "_t", "h", F.coalesce("root", "h").alias("_root"))
    stay = common.materialise(named.groupBy("_root").agg(F.min(F.struct("_null", "_key", "_t", "h")).alias("_row")).select("_row.*"), "stay")
    # equal rows come once a task, so that a row repeated without end is few rows here
    own = ["_null", "_key", "_t", "h"]
    joined = hashed(docs, [*names, "_t"], once=True).select(*names, "_t", *_mark(key), "h").join(stay, own, "left_semi")
    place = F.row_number().over(Window.partitionBy(*own).orderBy("_t"))
    return restored(joined.withColumn("_place", place).where("_place = 1"))
