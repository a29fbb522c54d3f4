"""Best-fit packing of documents into sequences of several permitted lengths.

Best fit decreasing needs only how many pieces there are of each length, so the packing itself works
on a histogram, whose size the greatest capacity bounds, whatever the input. Open bins are kept as
ranges of bin numbers per free space. Pieces of a length, longest lengths first, fill the fullest open
bins that hold them; when none does, bins are opened of the permitted size that costs least a
token, judged by filling one with the pieces still to come. In the end each bin shrinks to the
smallest permitted size that holds its contents.

The result is a list of placements: runs of pieces of one length, by their rank, into runs of bins.
Pieces are ranked within (length, salt), with offsets from the counts, so no length is gathered in
one task, and find their bin by a binary search.

A document longer than the greatest capacity is cut into pieces of it and a rest. Defined results: null
lengths count as 0, and documents of length 0 or less get no bin (a text has its end id at least, so each gets one);
pieces of one length rank by a salt of key and piece, then by key, so the packing does not hang on how the input is
split, but for repeated keys, which are packed each; null keys come first; very long texts are cut into pieces
as any; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, token_output

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Pieces of one length that one task ranks, about, at most.
SALT_ROWS = 50_000
#: Pairs of a length and a salt up to which their counts are broadcast, some 10 MB; more meet in a sorted join.
BROADCAST_ROWS = 200_000


def bin_cost(capacity: int) -> float:
    """Of a sequence: its tokens, attention's growth with its length, and a fixed part."""
    return capacity * (1 + capacity / 65536) + 32


class Packing:
    """placements: (length, first rank, pieces, first bin, pieces per bin, offset); bins: (first, end, used, capacity)."""

    def __init__(self, histogram: dict[int, int], capacities=CAPACITIES, cost=bin_cost):
        self.capacities = sorted(set(capacities))
        self.cost = cost
        self.left = dict(histogram)
        self.lengths = sorted(self.left)
        self.placements: list[tuple[int, int, int, int, int, int]] = []
        #: free space -> ranges (first, end, used) of open bins
        self.open: dict[int, list[tuple[int, int, int]]] = {}
        self.spaces: list[int] = []
        self.n_bins = 0
        for length in reversed(self.lengths):
            self.place(length)
        found = [(first, end, used, self.capacities[bisect_left(self.capacities, used)]) for ranges in self.open.values() for first, end, used in ranges]
        self.bins = sorted(found)

    def put(self, space: int, piece: tuple[int, int, int]) -> None:
        if space not in self.open:
            self.open[space] = []
            insort(self.spaces, space)
        self.open[space].append(piece)

    def place(self, length: int) -> None:
        rank, left = 0, self.left[length]
        while left:
            k = bisect_left(self.spaces, length)
            if k == len(self.spaces):
                self.left[length] = left
                capacity = self.choose(length)
                many = -(-left // (capacity // length))
                self.put(capacity, (self.n_bins, self.n_bins + many, 0))
                self.n_bins += many
                continue
            space = self.spaces[k]
            first, end, used = self.open[space].pop()
            per = space // length
            full = min(end - first, left // per)
            if full:  # these bins take all that goes in
                self.placements.append((length, rank, full * per, first, per, used))
                self.put(space - per * length, (first, first + full, used + per * length))
                rank, left, first = rank + full * per, left - full * per, first + full
            if left and first < end:  # one bin takes the rest
                self.placements.append((length, rank, left, first, per, used))
                self.put(space - left * length, (first, first + 1, used + left * length))
                rank, left, first = rank + left, 0, first + 1
            if first < end:
                self.open[space].append((first, end, used))
            if not self.open[space]:
                del self.open[space]
                self.spaces.remove(space)
        self.left[length] = 0

    def choose(self, length: int) -> int:
        """The permitted size whose bin, filled with pieces still to come, costs least a token."""
        best = None
        for capacity in self.capacities[bisect_left(self.capacities, length) :]:
            space, now, used = capacity, length, 0
            while space and now:
                take = min(self.left[now], space // now)
                used += take * now
                space -= take * now
                k = bisect_left(self.lengths, min(now, space + 1)) - 1
                while k >= 0 and not self.left[self.lengths[k]]:
                    k -= 1
                now = self.lengths[k] if k >= 0 else 0
            shrunk = self.capacities[bisect_left(self.capacities, used)]
            score = self.cost(shrunk) / used
            if best is None or score < best[0]:
                best = (score, capacity)
        return best[1]


class Finder:
    """Places of (length, rank) pairs, by binary search in the placements."""

    def __init__(self, packing: Packing):
        rows = np.array(sorted(packing.placements), dtype=np.int64).reshape(-1, 6)
        self.rows = rows
        self.key = rows[:, 0] << 44 | rows[:, 1]
        self.bins = np.array(packing.bins, dtype=np.int64).reshape(-1, 4)

    def find(self, length: np.ndarray, rank: np.ndarray):
        at = self.rows[np.searchsorted(self.key, length << 44 | rank, side="right") - 1]
        inside = rank - at[:, 1]
        number = at[:, 3] + inside // at[:, 4]
        own = self.bins[np.searchsorted(self.bins[:, 0], number, side="right") - 1]
        return number, at[:, 5] + inside % at[:, 4] * length, own[:, 2], own[:, 3]


def _locate(batches, held, passed):
    for batch in batches:
        if not batch.num_rows:
            continue
        number, offset, used, capacity = held.value.find(common.column(batch, "n_tokens").to_numpy(), common.column(batch, "_rank").to_numpy())
        names = [*passed, "piece", "n_tokens"]
        yield pa.RecordBatch.from_arrays(
            [*(common.column(batch, c) for c in names), pa.array(number), pa.array(offset), pa.array(used), pa.array(capacity)],
            names=[*names, "bin_id", "bin_offset", "bin_used", "capacity"],
        )


def pack(lengths: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacities=CAPACITIES, cost=bin_cost, row: str | None = None) -> DataFrame:
    """key, piece, n_tokens, bin_id, bin_offset, bin_used, capacity of every piece of every row.

    Piece p of a row holds its tokens from ``p * max(capacities)`` on. With ``row``, a column of
    distinct longs, that column is passed as well.
    """
    spark = lengths.sparkSession
    common.ship(spark)
    most = max(capacities)
    n = F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long"))
    own = F.col(row) if row else F.monotonically_increasing_id()
    # a row's number lasts, as the table is written
    rows = lengths.select(F.col(key), n.alias("_n"), own.alias("_row")).where("_n > 0")
    pieces = rows.select(key, "_row", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {most}"))).alias("piece"))
    pieces = pieces.select(key, "_row", "piece", F.least(F.lit(most), F.col("_n") - F.col("piece") * most).cast("long").alias("n_tokens"))
    pieces = common.materialise(pieces, "pieces")
    total = pieces.count()
    salts = max(common.partitions(spark), -(-total // SALT_ROWS))  # one length may have most of the pieces
    salt = F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    counts = salted.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_k"))
    histogram = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("_k")).collect()}  # at most as many rows as the greatest capacity
    before = counts.select("n_tokens", "_salt", (F.sum("_k").over(Window.partitionBy("n_tokens").orderBy("_salt")) - F.col("_k")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece", "_row")).cast("long")
    if salts * len(histogram) <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = salted.withColumn("_own", rank).join(before, ["n_tokens", "_salt"]).select(key, "_row", "piece", "n_tokens", (F.col("_own") - 1 + F.col("_before")).alias("_rank"))
    held = spark.sparkContext.broadcast(Finder(Packing(histogram, capacities, cost)))
    passed = [key, "_row"] if row else [key]
    schema = ranked.select(*passed).schema.add("piece", "long").add("n_tokens", "long").add("bin_id", "long").add("bin_offset", "long").add("bin_used", "long").add("capacity", "long")
    found = ranked.mapInArrow(lambda batches: _locate(batches, held, passed), schema)
    return found.withColumnRenamed("_row", row) if row else found


def pack_texts(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", capacities=CAPACITIES, cost=bin_cost) -> DataFrame:
    """As pack, for the numbers of tokens that the tokenizer gives each text, an end id included."""
    return pack(token_output.token_counts(docs, tokenizer_path, [key]), key, "n_tokens", capacities, cost)


SEQUENCE_SCHEMA = "bin_id long, capacity long, n_tokens long, doc_ids array<long>, pieces array<long>, payload binary"


def _fill(batches):
    """Rows come sorted by bin and offset; a row for each bin, whose payload is a segment of ``token_output``."""
    now, held = None, []

    def close():
        counts = np.array([n for _, _, n, _ in held], dtype=np.int64)
        keys = [k for k, _, _, _ in held]
        whole = b"".join(own for _, _, _, own in held)
        ids = np.frombuffer(whole, "<u2" if len(whole) == 2 * int(counts.sum()) else "<u4")
        return *now, int(counts.sum()), keys, [p for _, p, _, _ in held], token_output.pack(keys, counts, ids)

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["bin_id", "capacity", "n_tokens", "doc_ids", "pieces", "payload"])

    for batch in common.slices(batches, "ids"):
        out = []
        columns = [common.column(batch, c).to_pylist() for c in ("bin_id", "capacity", "_key", "piece", "n_tokens", "ids")]
        for number, capacity, *part in zip(*columns, strict=True):
            if now is None or number != now[0]:
                if held:
                    out.append(close())
                now, held = (number, capacity), []
            held.append(part)
        if out:
            yield batch_of(out)
    if held:
        yield batch_of([close()])


def sequences(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", capacities=CAPACITIES, cost=bin_cost) -> DataFrame:
    """The packed token sequences: bin_id, capacity, n_tokens, doc_ids, pieces, payload.

    ``doc_ids`` and ``pieces`` name the parts in their order; ``payload`` holds all their ids and is read with
    ``token_output.unpack`` or ``read_range``. Keys are cast to longs.
    """
    spark = docs.sparkSession
    pieces = token_output.token_pieces(docs, tokenizer_path, key, max(capacities))
    pieces = common.materialise(pieces.withColumn("_place", F.monotonically_increasing_id()), "token-pieces")
    placed = pack(pieces.select("_key", "n_tokens", "_place"), "_key", "n_tokens", capacities, cost, row="_place")
    parts = placed.select("_place", "bin_id", "bin_offset", "capacity").join(pieces, "_place")
    ordered = parts.repartition(common.partitions(spark), "bin_id").sortWithinPartitions("bin_id", "bin_offset")
    return ordered.select("bin_id", "capacity", "_key", "piece", "n_tokens", "ids").mapInArrow(_fill, SEQUENCE_SCHEMA)
