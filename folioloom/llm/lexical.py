"""Ranked lexical search by the three phases of TPUT over term-partitioned postings.

The items of a search are taken in blocks of bounded size, each against all documents. For a block, one pass over
the documents counts its terms, in segments of some thousand documents, and a second one turns the segments into
postings: lists of a term, one piece a segment, in falling order of the term's share in the document. Pieces are dealt
out by term, and a frequent term's further by segment, so no list is ever in one place.

1. The heads of all lists, K postings each, give partial scores; an item's K-th best is a lower bound of its K-th score.
2. That bound over the item's number of lists is the least contribution it asks of each list. A list is cut at the
   lowest share that any item of the block asks of it. What was fetched is summed by document; a document's missing
   terms lie below the cuts, which bounds its score from above. Who is in no fetched piece cannot reach the bound.
3. The K-th best sum of the second phase raises the bound, and the remaining candidates' exact scores
   are looked up in their segments.

The K best scores of each segment meet in one window per item, at most K of a task.

What the driver holds, of one block at a time: its items' terms, and a weight, a cut and a count each; no documents.

Defined results: null and empty texts have no term, and such documents do not count; an item without terms, or without
matching documents, has no rows; repeated rows, of items or documents, each count; null keys of documents come last
among equal scores; keys must be whole numbers; a very long text is counted in parts; empty tables give an
empty table; further columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, terms

BEST = 50
#: Documents, and postings, after which a segment is closed (a document is never cut).
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1 << 20
#: Bytes of the terms of a block of items, about.
BLOCK_BYTES = 8 << 20
#: Pieces of one list that one task is dealt, about.
PIECES_A_TASK = 512
FORWARD = "segment long, doc_ids array<long>, n_terms array<long>, indptr binary, terms binary, tfs binary"
POSTINGS = "term int, segment long, place int, top long, slots binary, shares binary"


@dataclass
class Items:
    """A block of items: distinct terms, and each item's number and the places of its terms among them."""

    terms: list[bytes]
    numbers: list[int]
    own: list[np.ndarray]


@dataclass
class Index:
    """Documents' terms by segment, N, L, and of each of the block's terms how many documents hold it and its weight."""

    forward: DataFrame
    n_docs: int
    n_terms: int
    df: np.ndarray
    pieces: np.ndarray
    weight: np.ndarray


# --- items


def _item_terms(batches):
    for batch in common.slices(batches, "text", terms.PART_BYTES):
        numbers, found = [], []
        for number, text in zip(common.column(batch, "_no").to_pylist(), common.text_bytes(common.column(batch, "text")), strict=True):
            own = set()
            for part in terms.parts(text):
                own.update(terms.Terms([part]).listed())
            numbers += [number] * len(own)
            found += sorted(own)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], names=["_no", "term"])


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """``items`` (_no, text) in blocks whose terms have about ``block_bytes``."""
    found = common.materialise(items.select("_no", F.col("text").cast("string").alias("text")).mapInArrow(_item_terms, "_no long, term binary"), "item-terms")
    size = found.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        rows = found.where(F.pmod(F.xxhash64("_no"), F.lit(n)) == k).collect()  # a block: bounded
        vocabulary = sorted({bytes(r["term"]) for r in rows})
        place = {t: p for p, t in enumerate(vocabulary)}
        own: dict[int, list[int]] = {}
        for r in rows:
            own.setdefault(r["_no"], []).append(place[bytes(r["term"])])
        if rows:
            yield Items(vocabulary, list(own), [np.array(p) for p in own.values()])


# --- the index of a block's terms


def _counted(texts: list[bytes], place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, known term) cells with their counts, in order."""
    n = np.zeros(len(texts), dtype=np.int64)
    cells, counts = [], []
    long = len(texts) == 1 and len(texts[0]) > terms.PART_BYTES
    for part in terms.parts(texts[0]) if long else [None]:
        found = terms.Terms([part] if long else texts)
        n += found.counts
        known = np.fromiter((place.get(t, -1) for t in found.listed()), np.int64, len(found.starts))
        owner = np.repeat(np.arange(len(texts)), found.counts)
        cell, count = np.unique((owner * len(place) + known)[known >= 0], return_counts=True)
        cells.append(cell)
        counts.append(count)
    if not long:
        return n, cells[0], counts[0]
    cell, at = np.unique(np.concatenate(cells), return_inverse=True)
    return n, cell, np.bincount(at, np.concatenate(counts), len(cell)).astype(np.int64)


def _forward(batches, vocabulary: list[bytes], segment_docs: int):
    from pyspark import TaskContext

    place = {t: p for p, t in enumerate(vocabulary)}
    number = TaskContext.get().partitionId() << 32
    ids, n_terms, sizes, cells, counts = [], [], [], [], []

    def segment():
        columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([n_terms], pa.list_(pa.int64()))]
        blobs = [np.r_[0, np.cumsum(np.concatenate(sizes))].astype("<i8"), np.concatenate(cells).astype("<u4"), np.concatenate(counts).astype("<u4")]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["segment", "doc_ids", "n_terms", "indptr", "terms", "tfs"])

    for batch in common.slices(batches, "text", terms.PART_BYTES):
        keys = common.column(batch, "_key").to_pylist()
        n, cell, count = _counted(common.text_bytes(common.column(batch, "text")), place)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        ids += [keys[k] for k in some]
        n_terms += n[some].tolist()
        sizes.append(np.bincount(cell // len(place), minlength=len(n))[some])
        cells.append(cell % len(place))
        counts.append(count)
        if len(ids) >= segment_docs or sum(map(len, cells)) >= SEGMENT_POSTINGS:
            yield segment()
            number += 1
            ids, n_terms, sizes, cells, counts = [], [], [], [], []
    if ids:
        yield segment()


def _frequencies(batches, n_vocabulary: int):
    df, pieces = np.zeros(n_vocabulary, np.int64), np.zeros(n_vocabulary, np.int64)
    for batch in batches:
        for blob in common.column(batch, "terms").to_pylist():
            found = np.bincount(np.frombuffer(blob, "<u4"), minlength=n_vocabulary)
            df += found
            pieces += found > 0
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used]), pa.array(pieces[used])], names=["term", "df", "pieces"])


def build(docs: DataFrame, key: str, vocabulary: list[bytes], segment_docs: int = SEGMENT_DOCS) -> Index:
    """Counts of the vocabulary's terms in ``docs`` (key, text), by segment."""
    common.ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("_key"), F.col("text").cast("string").alias("text"))
    forward = common.materialise(source.mapInArrow(lambda batches: _forward(batches, vocabulary, segment_docs), FORWARD), "forward")
    totals = forward.agg(F.sum(F.size("doc_ids").cast("long")).alias("n"), F.sum(F.aggregate("n_terms", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    df, pieces = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    found = forward.select("terms").mapInArrow(lambda batches: _frequencies(batches, len(vocabulary)), "term int, df long, pieces long")
    for row in found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("pieces").alias("pieces")).collect():  # a row a term of the block
        df[row["term"]], pieces[row["term"]] = row["df"], row["pieces"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], dtype=np.int64)
    return Index(forward, n_docs, n_terms, df, pieces, weight)


def _shares(tfs: np.ndarray, n_terms: np.ndarray, owner: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 20 m) of postings; m, by document, in Python's whole numbers."""
    m = np.array([50 + 50 * n * n_docs // all_terms for n in n_terms.tolist()], dtype=np.int64)
    tf = tfs.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m[owner])


def _pieces(batches, n_docs: int, all_terms: int, spread: np.ndarray):
    for batch in batches:
        for row in range(batch.num_rows):
            indptr, found, tfs = (np.frombuffer(common.column(batch, c)[row].as_py(), kind) for c, kind in (("indptr", "<i8"), ("terms", "<u4"), ("tfs", "<u4")))
            if not len(found):
                continue
            segment = common.column(batch, "segment")[row].as_py()
            owner = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
            share = _shares(tfs, common.column(batch, "n_terms")[row].values.to_numpy(), owner, n_docs, all_terms)
            order = np.lexsort((owner, -share, found))
            term, owner, share = found[order], owner[order].astype("<u4"), share[order].astype("<u4")
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            ends = [*starts[1:].tolist(), len(term)]
            numbers = term[starts].astype(np.int64)
            mixed = (segment * 0x9E3779B1 ^ (segment >> 32) * 0x85EBCA6B) & 0x7FFFFFFF
            blobs = [pa.array([values[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()) for values in (owner, share)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers.astype(np.int32)), pa.array(np.full(len(starts), segment)), pa.array((mixed % spread[numbers]).astype(np.int32)), pa.array(share[starts].astype(np.int64)), *blobs],
                names=["term", "segment", "place", "top", "slots", "shares"],
            )


def postings(index: Index) -> DataFrame:
    """The written lists: a row for each term and segment, its postings in falling order of share.

    slots are places of documents in the segment, shares their contributions but for the term's weight (4 bytes each).
    """
    spread = -(-np.maximum(index.pieces, 1) // PIECES_A_TASK)
    n_docs, all_terms = index.n_docs, index.n_terms
    found = index.forward.mapInArrow(lambda batches: _pieces(batches, n_docs, all_terms, spread), POSTINGS)
    dealt = found.repartition(common.partitions(found.sparkSession), "term", "place").sortWithinPartitions("term", F.desc("top"))
    return common.materialise(dealt, "postings")


# --- the three phases


def _heads(batches, k: int):
    """The k best postings of each term of a task, whose pieces come in a row."""
    now, held, kept = None, [], 0

    def best():
        share = np.concatenate([h[2] for h in held])
        pick = np.argsort(-share.astype(np.int64), kind="stable")[:k]
        return np.concatenate([np.full(len(h[1]), h[0]) for h in held])[pick], np.concatenate([h[1] for h in held])[pick], share[pick]

    def rows():
        segment, slot, share = best()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), now, np.int32)), pa.array(segment), pa.array(slot.astype(np.int32)), pa.array(share.astype(np.int64))], names=["term", "segment", "slot", "share"])

    for batch in batches:
        for row in range(batch.num_rows):
            term, segment = common.column(batch, "term")[row].as_py(), common.column(batch, "segment")[row].as_py()
            if term != now and held:
                yield rows()
                held, kept = [], 0
            now = term
            slots, shares = (np.frombuffer(common.column(batch, c)[row].as_py(), "<u4")[:k] for c in ("slots", "shares"))
            held.append((segment, slots, shares))
            kept += len(slots)
            if kept > 64 * k:
                segments, slots, shares = best()
                held = [(s, slots[segments == s], shares[segments == s]) for s in np.unique(segments)]
                kept = len(slots)
    if held:
        yield rows()


def _kth(best: DataFrame, value: str, k: int) -> dict[int, int]:
    """The k-th largest value of each item that has k: a row an item."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value)))
    return {r["item"]: r[value] for r in best.select("item", value, place.alias("_at")).where(f"_at <= {k}").where(f"_at = {k}").collect()}


def first_bounds(lists: DataFrame, items: Items, weight: np.ndarray, k: int) -> np.ndarray:
    """Of each item the k-th best sum over the heads of its lists, 0 if fewer documents are in them."""
    spark = lists.sparkSession
    found = lists.select("term", "segment", "slots", "shares").mapInArrow(lambda batches: _heads(batches, k), "term int, segment long, slot int, share long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("share")))
    heads = found.withColumn("_at", place).where(f"_at <= {k}").drop("_at")
    asked = pa.table({"item": pa.array(np.repeat(np.arange(len(items.own)), [len(o) for o in items.own])), "term": pa.array(np.concatenate(items.own).astype(np.int32)), "weight": pa.array(weight[np.concatenate(items.own)])})
    sums = heads.join(spark.createDataFrame(asked), "term").groupBy("item", "segment", "slot").agg(F.sum(F.col("weight") * F.col("share")).alias("low"))
    low = _kth(sums, "low", k)
    return np.array([low.get(i, 0) for i in range(len(items.own))], dtype=np.int64)


def cuts(items: Items, weight: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The least share that is fetched of each list: what any item asks of it."""
    out = np.full(len(weight), np.iinfo(np.int64).max)
    for own, bound in zip(items.own, low.tolist(), strict=True):
        own = own[weight[own] > 0]
        if len(own):
            asked = -(-bound // len(own))
            out[own] = np.minimum(out[own], np.maximum(1, -(-asked // weight[own])))
    return out


def _fetched(batches, cut: np.ndarray):
    for batch in batches:
        term = common.column(batch, "term").to_numpy()
        for row in np.flatnonzero(common.column(batch, "top").to_numpy() >= cut[term]).tolist():
            shares = np.frombuffer(common.column(batch, "shares")[row].as_py(), "<u4")
            n = int(np.count_nonzero(shares >= cut[term[row]]))
            yield pa.RecordBatch.from_arrays(
                [common.column(batch, "segment").slice(row, 1), common.column(batch, "term").slice(row, 1), pa.array([common.column(batch, "slots")[row].as_py()[: 4 * n]], pa.binary()), pa.array([shares[:n].tobytes()], pa.binary())],
                names=["segment", "term", "slots", "shares"],
            )


def fetch(lists: DataFrame, cut: np.ndarray) -> DataFrame:
    """Every list down to its cut."""
    return lists.mapInArrow(lambda batches: _fetched(batches, cut), "segment long, term int, slots binary, shares binary")


def _candidates(batches, own: list[np.ndarray], weight: np.ndarray, cut: np.ndarray, low: np.ndarray, k: int):
    below = np.where(weight > 0, weight * (np.minimum(cut, 1 << 30) - 1), 0)
    now, held = None, {}

    def rows():
        out = {name: [] for name in ("item", "best", "slots", "uppers")}
        for item, wanted in enumerate(own):
            there = [t for t in wanted.tolist() if t in held]
            if not there:
                continue
            slots = np.concatenate([held[t][0] for t in there])
            sizes = [len(held[t][0]) for t in there]
            got = np.bincount(slots, np.concatenate([held[t][1] * weight[t] for t in there]))
            covered = np.bincount(slots, np.repeat(below[there], sizes))
            seen = np.flatnonzero(np.bincount(slots))
            got, upper = got[seen].astype(np.int64), (got + below[wanted].sum() - covered)[seen].astype(np.int64)
            best = -np.sort(-got)[:k]
            bound = max(1, low[item], best[-1] if len(best) == k else 0)
            stay = upper >= bound
            if stay.any():
                out["item"].append(item)
                out["best"].append(best)
                out["slots"].append(seen[stay].astype("<u4").tobytes())
                out["uppers"].append(upper[stay].astype("<i8").tobytes())
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(out["item"]), now, np.int64)), *(pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True))], names=["segment", *out])

    for batch in batches:
        for row in range(batch.num_rows):
            segment = common.column(batch, "segment")[row].as_py()
            if segment != now and held:
                yield rows()
                held = {}
            now = segment
            slots, shares = (np.frombuffer(common.column(batch, c)[row].as_py(), "<u4").astype(np.int64) for c in ("slots", "shares"))
            held[common.column(batch, "term")[row].as_py()] = slots, shares
    if held:
        yield rows()


def candidates(fetched: DataFrame, items: Items, weight: np.ndarray, cut: np.ndarray, low: np.ndarray, k: int) -> DataFrame:
    """item, segment, the k best sums there, and the places and upper bounds of documents that may be among the item's k best."""
    own = items.own
    dealt = fetched.repartition(common.partitions(fetched.sparkSession), "segment").sortWithinPartitions("segment")
    found = dealt.mapInArrow(lambda batches: _candidates(batches, own, weight, cut, low, k), "segment long, item int, best array<long>, slots binary, uppers binary")
    return common.materialise(found, "candidates")


def look_up(index: Index, found: DataFrame, items: Items, low: np.ndarray, k: int) -> DataFrame:
    """item, doc_id and exact score of the k best candidates of each segment that reach the bound."""
    own, weight, n_docs, all_terms = items.own, index.weight, index.n_docs, index.n_terms

    def scored(segments: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"item": [], "doc_id": [], "score": []}
        if segments.num_rows and asked.num_rows:
            row = segments.combine_chunks().to_batches()[0]
            indptr, found_terms, tfs = (np.frombuffer(common.column(row, c)[0].as_py(), kind) for c, kind in (("indptr", "<i8"), ("terms", "<u4"), ("tfs", "<u4")))
            n_terms = common.column(row, "n_terms")[0].values.to_numpy()
            ids = common.column(row, "doc_ids")[0].as_py()
            owner = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
            share = _shares(tfs, n_terms, owner, n_docs, all_terms)
            for item, slots, uppers in zip(*(asked.column(c).to_pylist() for c in ("item", "slots", "uppers")), strict=True):
                slots = np.frombuffer(slots, "<u4")[np.frombuffer(uppers, "<i8") >= low[item]].astype(np.int64)
                wanted = np.zeros(len(weight), dtype=np.int64)
                wanted[own[item]] = weight[own[item]]
                sizes = indptr[slots + 1] - indptr[slots]
                at = common.ragged(indptr[slots], sizes)
                sums = np.r_[0, np.cumsum(wanted[found_terms[at]] * share[at])]
                ends = np.cumsum(sizes)
                scores = (sums[ends] - sums[ends - sizes]).tolist()
                ranked = sorted(((-s, ids[p] is None, ids[p] or 0) for s, p in zip(scores, slots.tolist(), strict=True) if s > 0))[:k]
                out["item"] += [item] * len(ranked)
                out["doc_id"] += [None if unknown else doc for _, unknown, doc in ranked]
                out["score"] += [-s for s, _, _ in ranked]
        return pa.table({"item": pa.array(out["item"], pa.int32()), "doc_id": pa.array(out["doc_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    asked = found.select("segment", "item", "slots", "uppers")
    return index.forward.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(scored, "item int, doc_id long, score long")


def search_block(docs: DataFrame, items: Items, k: int, key: str, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """_no, rank, doc_id, score of one block's items."""
    spark = docs.sparkSession
    index = build(docs, key, items.terms, segment_docs)
    lists = postings(index)
    low = first_bounds(lists, items, index.weight, k)
    cut = cuts(items, index.weight, low)
    found = candidates(fetch(lists, cut), items, index.weight, cut, low, k)
    again = _kth(found.select("item", F.explode("best").alias("low")), "low", k)
    low = np.array([max(bound, again.get(i, 0)) for i, bound in enumerate(low.tolist())], dtype=np.int64)
    scores = look_up(index, found, items, low, k)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = scores.withColumn("rank", place).where(f"rank <= {k}")
    numbers = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(items.numbers), dtype=np.int32)), "_no": pa.array(items.numbers, pa.int64())}))
    return ranked.join(numbers, "item").select("_no", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, key: str = "doc_id", item_key: str = "item_id", block_bytes: int = BLOCK_BYTES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """item key, rank, key and score of the ``k`` best documents (key, text) of each row of ``items`` (item key, text)."""
    spark = docs.sparkSession
    common.ship(spark)
    numbered = common.materialise(items.select(F.col(item_key).alias("_item"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("_no")), "items")
    out = spark.createDataFrame([], "_no long, rank int, doc_id long, score long")
    for block in blocks(numbered, block_bytes):
        out = out.unionByName(search_block(docs, block, k, key, segment_docs))
    named = out.join(numbered.select("_no", "_item"), "_no")
    return named.select(F.col("_item").alias(item_key), "rank", F.col("doc_id").alias(key), "score")
