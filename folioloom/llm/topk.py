"""Exact top-k by inner product, with no-random-access aggregation over sorted lists.

Vectors are quantised to whole numbers. A group of candidates has one sorted list per component. All
lists are read from both ends to the same depth, and what was read bounds every candidate's score from
both sides: a component that was seen counts as it is; one that was not is at most the last value read from
the list's top and at least its least value (the other way round for a negative weight). For a block of queries
both bounds are matrix products with the candidates' matrix clipped at the depth. The k-th greatest lower bound
is a query's threshold; candidates with an upper bound under it cannot qualify. Once few enough are left their
final scores are resolved, else the lists are read further; at their end both bounds are the score.

Candidates stream past each block of queries in groups, and a query's threshold goes on from group to
group, so one bound holds for all that a task reads. A block's candidates are dealt to several lanes where there are
few blocks; each lane returns k rows a query, so the merge is small. Work grows as queries times
candidates, as for any exact search of vectors that no list separates.

Defined results: vectors that are null or hold null or non-finite components take no part. Every other row
does, as a candidate of its own: rows may share a vec_id (each that is a query is answered, and is no candidate
for itself alone) and may have none (it comes after others of its score). An empty vector, and what a shorter
vector lacks, counts as zeros. Components may be of any size: sums are exact, in whole numbers of any
length where doubles cannot hold them, and rank as such; a score beyond a long is given as the nearest long.
Ties go to the smaller vec_id; a query with fewer than k candidates gets all of them; an empty table gives an
empty table; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import common

K = 5
SCALE = 256
#: Candidates of a group, queries of a block, and queries whose bounds are held at once.
GROUP, QUERY_BLOCK, QUERY_ROWS = 16_384, 4096, 128
#: A lane has so many candidates at least.
LANE_ROWS = 2048
#: Depths, as shares of the lists, at which bounds are compared.
DEPTHS = (0.25, 0.5, 0.75, 1.0)
LONG = 1 << 63


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(_row, vec_id, v): all rows that take part, components as they are."""
    kind = vectors.schema[embedding].dataType
    element = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    fit = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{element}>").alias("v"))
    return rows.where(F.col("v").isNotNull() & fit).select(F.monotonically_increasing_id().alias("_row"), "vec_id", "v")


def whole_numbers(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 * x) of doubles, and which rows are too large for exact sums of doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(SCALE * matrix)
    limit = 2.0 ** ((52 - max(1, matrix.shape[1]).bit_length()) // 2)
    return out, (np.abs(out) >= limit).any(axis=1) if matrix.size else np.zeros(len(matrix), bool)


def exact(row: np.ndarray) -> list[int]:
    """floor(256 * x) of doubles of any size."""
    return [(n * SCALE) // d for n, d in (float(x).as_integer_ratio() for x in row)]


class Found:
    """The best k of each query so far, and its threshold."""

    def __init__(self, rows: np.ndarray, k: int):
        self.rows, self.k = rows, k
        self.best: list[list[tuple]] = [[] for _ in rows]  # (-score, id is null, id), in order
        self.threshold = np.full(len(rows), -np.inf)

    def add(self, q: int, scores: list[int], ids: list[int | None]) -> None:
        merged = sorted([*self.best[q], *((-s, i is None, i or 0) for s, i in zip(scores, ids, strict=True))])[: self.k]
        self.best[q] = merged
        if len(merged) == self.k:
            # doubles may round the score up; then what ties with it would be lost
            score = -merged[-1][0]
            self.threshold[q] = max(self.threshold[q], score if abs(score) < 2**53 else np.nextafter(float(score), -np.inf) if abs(score) < 2**1000 else -np.inf)


class Group:
    """Candidates with their sorted lists; all of a size that doubles sum exactly."""

    def __init__(self, rows: np.ndarray, ids: list[int | None], matrix: np.ndarray):
        self.rows, self.ids = rows, ids
        self.matrix = matrix
        self.lists = np.sort(matrix, axis=0)
        self.largest = float(np.abs(matrix).max()) if matrix.size else 0.0
        self.reads = 0

    def search(self, found: Found, which: np.ndarray, queries: np.ndarray) -> None:
        """Add this group's best to the queries ``which`` of ``found``."""
        n, width = self.matrix.shape
        narrow = self.largest * (float(np.abs(queries).max()) if queries.size else 0.0) * width < 2**24
        kind = np.float32 if narrow else np.float64  # sums of whole numbers, exact in either
        v, lists = self.matrix.astype(kind), self.lists.astype(kind)
        place = {row: at for at, row in enumerate(self.rows.tolist())}
        for low in range(0, len(which), QUERY_ROWS):
            self._block(found, which[low : low + QUERY_ROWS], queries[low : low + QUERY_ROWS].astype(kind), v, lists, place)

    def _block(self, found, which, weights, v, lists, place) -> None:
        n, k = len(v), found.k
        own = np.array([place.get(row, -1) for row in found.rows[which].tolist()], dtype=np.int64)
        left, share = np.arange(len(which)), 0.0
        for depth in DEPTHS:
            if depth < 1.0 and share > 0.5 and depth < last + 0.5:
                continue  # far from a decision: read twice as far
            last = depth
            read = max(1, int(depth * n))
            self.reads += read * v.shape[1]
            w = weights[left]
            itself = np.flatnonzero(own[left] >= 0)
            if read >= n:
                upper = lower = w @ v.T
            else:
                both = np.concatenate([np.maximum(w, 0), np.minimum(w, 0)], axis=1)
                top, bottom = lists[n - read], lists[read - 1]
                upper = both @ np.concatenate([np.maximum(v, top), np.minimum(v, bottom)], axis=1).T
                lower = None
                if not np.isfinite(found.threshold[which[left]]).all():
                    lower = both @ np.concatenate([np.where(v >= top, v, lists[0]), np.where(v <= bottom, v, lists[-1])], axis=1).T
            upper[itself, own[left[itself]]] = -np.inf
            threshold = found.threshold[which[left]]
            if lower is not None:
                lower[itself, own[left[itself]]] = -np.inf
                if n > k:
                    threshold = np.maximum(threshold, np.partition(lower, n - k, axis=1)[:, n - k])
            alive = upper >= threshold[:, None]
            alive[itself, own[left[itself]]] = False
            counts = alive.sum(axis=1)
            done = (counts <= max(64, n // 32)) | (read >= n)
            for at in np.flatnonzero(done & (counts > 0)).tolist():
                some = np.flatnonzero(alive[at])
                scores = upper[at, some] if read >= n else v[some] @ w[at]
                if len(some) > 4 * k:  # ties with the k-th stay
                    some, scores = (x[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]] for x in (some, scores))
                found.add(int(which[left[at]]), [int(s) for s in scores.tolist()], [self.ids[c] for c in some.tolist()])
            share = float(np.mean(counts[~done])) / n if not done.all() else 0.0
            left = left[~done]
            if not len(left):
                return


def _vectors(lists: pa.Array, width: int = 0) -> np.ndarray:
    """A matrix padded with zeros."""
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    width = max(width, int(lengths.max()) if len(lengths) else 0)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), lengths), common.ragged(np.zeros(len(lists), np.int64), lengths)] = lists.flatten().to_numpy()
    return out


def _widened(matrices: list[np.ndarray]) -> np.ndarray:
    width = max(m.shape[1] for m in matrices)
    return np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices])


class Lane:
    """A block's queries, and the candidates that stream past them."""

    def __init__(self, k: int):
        self.k = k
        self.parts: list[tuple[np.ndarray, list, np.ndarray]] = []
        self.held = 0
        self.found = None

    def queries(self, rows, ids, matrix) -> None:
        self.parts.append((rows, ids, matrix))

    def _begin(self) -> None:
        rows = np.concatenate([r for r, _, _ in self.parts])
        self.query_ids = [i for _, ids, _ in self.parts for i in ids]
        self.raw = _widened([m for _, _, m in self.parts])
        self.whole, self.huge = whole_numbers(self.raw)
        self.found = Found(rows, self.k)
        self.parts = []

    def candidates(self, rows, ids, matrix) -> None:
        if self.found is None:
            if not self.parts:
                return  # no query
            self._begin()
        self.parts.append((rows, ids, matrix))
        self.held += len(rows)
        if self.held >= GROUP:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        rows = np.concatenate([r for r, _, _ in self.parts])
        ids = [i for _, own, _ in self.parts for i in own]
        raw = _widened([m for _, _, m in self.parts])
        self.parts, self.held = [], 0
        width = max(raw.shape[1], self.raw.shape[1])
        raw = np.pad(raw, ((0, 0), (0, width - raw.shape[1])))
        whole, huge = whole_numbers(raw)
        weights = np.pad(self.whole, ((0, 0), (0, width - self.whole.shape[1])))
        usual, asked = np.flatnonzero(~huge), np.flatnonzero(~self.huge)
        if len(usual) and len(asked):
            Group(rows[usual], [ids[c] for c in usual.tolist()], whole[usual]).search(self.found, asked, weights[asked])
        # what doubles cannot sum: in whole numbers, one by one
        for q in range(len(weights)):
            others = np.arange(len(rows)) if self.huge[q] else np.flatnonzero(huge)
            others = others[rows[others] != self.found.rows[q]]
            if len(others):
                query = exact(self.raw[q])
                scores = [sum(a * b for a, b in zip(query, exact(raw[c]), strict=False)) for c in others.tolist()]
                self.found.add(q, scores, [ids[c] for c in others.tolist()])

    def result(self) -> pa.RecordBatch | None:
        self.flush()
        if self.found is None:
            return None
        rows = [(int(row), query, None if none else i, max(-LONG, min(LONG - 1, -s)), _beyond(-s)) for row, query, best in zip(self.found.rows, self.query_ids, self.found.best, strict=True) for s, none, i in best]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["_query", "query_id", "vec_id", "score", "_beyond"])


def _beyond(score: int) -> str | None:
    """Of a score that a long cannot hold, a text that sorts as its size does."""
    digits = str(abs(score))
    return f"{len(digits):05d}{digits}" if not -LONG <= score < LONG else None


def _lanes(batches, k):
    """Rows come sorted by (b, lane, kind): the queries of a lane, then its candidates."""
    now, lane = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [common.column(batch, c).to_numpy() for c in ("b", "lane", "kind")]
        rows, ids = common.column(batch, "_row").to_numpy(), common.column(batch, "vec_id").to_pylist()
        matrix = _vectors(common.column(batch, "v"))
        cut = np.flatnonzero(np.r_[True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])])
        for low, high in zip(cut, [*cut[1:], batch.num_rows], strict=True):
            own = (keys[0][low], keys[1][low])
            if own != now:
                if lane and (out := lane.result()):
                    yield out
                now, lane = own, Lane(k)
            (lane.candidates if keys[2][low] else lane.queries)(rows[low:high], ids[low:high], matrix[low:high])
    if lane and (out := lane.result()):
        yield out


def search(vectors: DataFrame, is_query: Column, embedding: str = "embedding", k: int = K, block: int = QUERY_BLOCK, lane_rows: int = LANE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; ``is_query`` is on vec_id."""
    spark = vectors.sparkSession
    common.ship(spark)
    rows = common.materialise(usable(vectors, embedding), "vectors")
    total, queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    n = common.partitions(spark)
    blocks = max(1, -(-queries // block))
    lanes = max(1, min(-(-n // blocks), total // lane_rows))
    of_lane = F.pmod(F.xxhash64("_row"), F.lit(lanes)).cast("int")
    of_block = F.pmod(F.xxhash64("_row", F.lit("query")), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    asked = rows.where(is_query).select(of_block.alias("b"), every(lanes).alias("lane"), F.lit(0).alias("kind"), "_row", "vec_id", "v")
    candidates = rows.select(every(blocks).alias("b"), of_lane.alias("lane"), F.lit(1).alias("kind"), "_row", "vec_id", "v")
    met = asked.unionByName(candidates).repartition(n, "b", "lane").sortWithinPartitions("b", "lane", "kind")
    found = met.mapInArrow(lambda b: _lanes(b, k), "_query long, query_id long, vec_id long, score long, _beyond string")
    size = F.coalesce(F.col("_beyond"), F.lit(""))
    order = [F.desc("score"), F.when(F.col("score") > 0, size).desc_nulls_last(), F.when(F.col("score") < 0, size).asc_nulls_first(), F.asc_nulls_last("vec_id")]
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
