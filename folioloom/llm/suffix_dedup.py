"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts elsewhere, in any document, is
removed. All starts are judged, exactly, in three steps that keep the sorting local:

1. *Buckets.* In each window of ``length`` bytes the 64-byte gram with the least hash (leftmost on a
   tie) is its anchor. Equal windows have equal anchors at equal places, so windows need
   comparing only within a bucket, the hash of their anchor. The run of starts that share an anchor
   is a segment: it is the bytes from its first start to the end of its last window.
2. *Equal segments.* A segment whose bytes occur twice (128-bit digests, counted with map-side
   sums) is repeated as a whole. A bucket with one distinct segment needs no sorting.
3. *Suffix arrays.* The distinct segments of the other buckets are brought together, joined, and
   suffix-sorted in two stages: suffixes smaller than their successors are sorted directly, the others
   induced by a scan over the buckets of first bytes. A start is repeated if its common prefix with
   a neighbour in the array reaches ``length``.

A bucket of over ``HOT_SEGMENTS`` distinct segments (a passage within very many different texts) is
not brought to one task: its windows are counted by digest instead, which is exact too, and the digests that
occur twice are looked up (if few, broadcast; else in a join).

Defined results: null texts are empty; texts shorter than ``length`` lose nothing; copies of a text
remove each other; repeated rows and repeated or null doc_ids are documents of their own; a very long text is
searched in overlapping parts, which changes no result; an empty table gives an empty table; further columns
are left out, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, unspaced

LENGTH = 400
GRAM = 64
HOT_SEGMENTS = 2000
#: Digests of strings repeated in such buckets up to which they are broadcast, 8 MB; more meet in a join.
BROADCAST_WINDOWS = 1 << 19
#: Bytes that are suffix-sorted at once (more only if one bucket has more).
SORT_BYTES = 1 << 20
#: Bytes of texts that are searched for anchors at once; a longer text is cut into overlapping parts.
PART_BYTES = 1 << 20
_PRIME = 0x100000001B3
_POWERS: dict[str, np.ndarray] = {}


# --- suffix sorting


def _words(text: np.ndarray, pad: int) -> np.ndarray:
    """For each place the eight bytes from there as a big-endian number, zeros beyond the end."""
    n = len(text)
    padded = np.zeros(n + pad + 8, dtype=np.uint64)
    padded[:n] = text
    out = padded[: n + pad].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : n + pad + k]
    return out


def _sort_directly(places: np.ndarray, words: np.ndarray, sums: np.ndarray, back: np.ndarray, n: int, depth: int) -> np.ndarray:
    """``places`` in the order of their suffixes' first ``depth`` bytes; shorter ones come first on a tie.

    Suffixes that tie are a group. Each is compared with the group's middle one: a binary search over prefix
    hashes gives their common prefix, whole words of eight bytes, and the next words their order. Those
    before the middle one rank by growing, those after it by falling length of the common prefix, then by the next
    word; what still ties is a group of the next turn. Turns grow as the logarithm of a group's size.
    """
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    at, head, tied = _ties(np.ones(len(order), dtype=bool), key)
    at, base = at[tied], np.full(int(tied.sum()), 8, dtype=np.int64)
    while len(at):
        place = order[at]
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        sizes = np.diff(np.r_[first, len(at)])
        middle = place[first + sizes // 2][group]
        shared = base
        for step in (256, 128, 64, 32, 16, 8):
            x, y = np.minimum(place + shared, n), np.minimum(middle + shared, n)
            left = (sums[np.minimum(x + step, n)] - sums[x]) * back[x]
            alike = left == (sums[np.minimum(y + step, n)] - sums[y]) * back[y]
            shared = shared + step * alike
        own, other = words[np.minimum(place + shared, len(words) - 1)], words[np.minimum(middle + shared, len(words) - 1)]
        done = shared >= depth
        rank = np.where(done | (own == other), 1 << 32, np.where(own < other, shared, (1 << 33) - shared))
        key = np.where(done, (n - place).astype(np.uint64), own)
        turn = np.lexsort((key, rank, group))
        order[at] = place[turn]
        key, rank, shared, live = key[turn], rank[turn], shared[turn], (~done & (place + shared < n))[turn]
        _, now, tied = _ties(live, key, group << 34 | rank)
        at, head, base = at[tied], now, shared[tied] + 8
    return order


def _ties(live: np.ndarray, key: np.ndarray, group: np.ndarray | None = None):
    """All places, which of the tied ones begin a group, and which are tied: live neighbours of one key (and group)."""
    same = (key[1:] == key[:-1]) & live[1:] & live[:-1]
    if group is not None:
        same &= group[1:] == group[:-1]
    tied = np.zeros(len(key), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    head = np.ones(len(key), dtype=bool)
    head[1:] = ~same
    return np.arange(len(key)), head[tied], tied


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte array in the order of their first ``depth`` bytes at least, and its words.

    Two-stage sorting: suffixes smaller than their successors are sorted; each other suffix follows
    from the place of its successor, in one pass over the buckets of first bytes.
    """
    n = len(text)
    words = _words(text, depth + 16)
    if not n:
        return np.zeros(0, np.int64), words
    change = np.r_[text[1:] != text[:-1], True]
    run_end = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
    after = np.where(run_end + 1 < n, text[np.minimum(run_end + 1, n - 1)].astype(np.int16), -1)
    larger = text > after  # than the successor
    forward, back = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(text.astype(np.uint64) * forward[:n], out=sums[1:])
    direct = _sort_directly(np.flatnonzero(~larger), words, sums, back, n, depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    pushed: list[list[np.ndarray]] = [[] for _ in range(256)]
    pushed[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        own = []
        now = np.concatenate(pushed[c]) if pushed[c] else np.zeros(0, np.int64)
        while len(now):  # a run of c grows backwards, one byte a turn
            own.append(now)
            now = now[now > 0] - 1
            now = now[text[now] == c]
        own.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(own)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            heads = text[before]
            rank = np.argsort(heads, kind="stable")
            before, heads = before[rank], heads[rank]
            cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            for low, high in zip(cuts, [*cuts[1:], len(heads)], strict=True):
                pushed[heads[low]].append(before[low:high])
    return np.concatenate(out), words


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment and each of its starts, whether the string there starts elsewhere too."""
    text = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    ends = np.cumsum(sizes)
    judged = np.zeros(len(text), dtype=bool)
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        judged[end - size : end - length + 1] = True
    array, words = suffix_array(text, length)
    array = array[judged[array]]
    left, right = array[:-1], array[1:]
    for step in [*range(0, length - 7, 8), max(0, length - 8)]:  # common prefixes, eight bytes a turn
        alike = words[left + step] == words[right + step]
        left, right = left[alike], right[alike]
    if length < 8:
        raise ValueError("length must be 8 at least")
    again = np.zeros(len(text), dtype=bool)
    again[left] = again[right] = True
    return [again[end - size : end - length + 1] for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


# --- anchors and segments


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "forward" not in _POWERS or len(_POWERS["forward"]) < n:
        size = max(n, 1 << 20)
        factor = np.full(size, _PRIME, dtype=np.uint64)
        factor[0] = 1
        inverse = np.full(size, pow(_PRIME, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        _POWERS["forward"], _POWERS["back"] = np.multiply.accumulate(factor), np.multiply.accumulate(inverse)
    return _POWERS["forward"][:n], _POWERS["back"][:n]


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    n = len(text)
    forward, back = _powers(n)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * forward, out=prefix[1:])
    h = (prefix[gram:] - prefix[: n + 1 - gram]) * back[: n + 1 - gram]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def segments_of(texts: list[bytes], length: int, gram: int = GRAM, part: int | None = None):
    """(text, first start, starts, bucket) arrays of all segments of texts."""
    part = part or PART_BYTES
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    n = int(ends[-1]) if len(ends) else 0
    if n < length:
        return none, none, none, none
    if n >= 2 * part + length:
        out = [(none,) * 4]
        if len(texts) > 1:
            for k, text in enumerate(texts):
                own = segments_of([text], length, gram, part)
                out.append((own[0] + k, *own[1:]))
        else:  # a very long text in overlapping parts; a segment cut in two is two segments
            for base in range(0, n - length + 1, part):
                own = segments_of([texts[0][base : base + part + length - 1]], length, gram, part)
                out.append((own[0], own[1] + base, *own[2:]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
    h = gram_hashes(whole, gram)
    width = length - gram + 1
    m = len(h)
    rows = -(-m // width)
    key = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    key[:m] = (h >> np.uint64(24) << np.uint64(24)) | np.arange(m, dtype=np.uint64)
    table = key.reshape(rows, width)
    prefix = np.minimum.accumulate(table, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - length + 1
    least = np.minimum(suffix[:starts], prefix[width - 1 : width - 1 + starts])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.ones(starts, dtype=bool)
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        valid[max(end - size, end - length + 1) : min(end, starts)] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none
    own = anchor[at]
    cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[cut]
    row = np.searchsorted(ends, first, side="right")
    return row, first - (ends - sizes)[row], np.diff(np.r_[cut, len(at)]), h[own[cut]].view(np.int64)


def digests(parts) -> np.ndarray:
    """128-bit digests as rows of two signed longs."""
    make = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([make(p) for p in parts]), dtype="<i8").reshape(-1, 2)


def _anchors(batches, length, gram):
    for batch in common.slices(batches, "text", PART_BYTES):
        copies: dict[bytes, int] = {}
        for text in common.text_bytes(common.column(batch, "text")):
            if len(text) >= length:
                copies[text] = copies.get(text, 0) + 1
        texts = list(copies)
        row, first, starts, bucket = segments_of(texts, length, gram)
        if not len(row):
            continue
        views = [memoryview(t) for t in texts]
        own = digests(views[r][f : f + s + length - 1] for r, f, s in zip(row.tolist(), first.tolist(), starts.tolist(), strict=True))
        content = digests(views)[row]
        many = np.array(list(copies.values()), dtype=np.int64)[row]
        columns = [bucket, own[:, 0], own[:, 1], content[:, 0], content[:, 1], first, starts, many]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["h", "s1", "s2", "c1", "c2", "lo", "m", "n"])


def _digest(column: pa.Array) -> tuple[list[bytes], list[pa.Array]]:
    texts = common.text_bytes(column)
    key = digests(texts)
    return texts, [pa.array(np.ascontiguousarray(key[:, k])) for k in (0, 1)]


def _keyed(batches, passed):
    """Passed columns, content key and text."""
    for batch in common.slices(batches, "text"):
        texts, key = _digest(common.column(batch, "text"))
        yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in passed), *key, pa.array(texts, pa.binary())], names=[*passed, "c1", "c2", "_bytes"])


def _distinct(batches, length):
    """Content key and text, each text of a task once, so that a group of copies gives a row a task at most."""
    seen = set()
    for batch in common.slices(batches, "text"):
        texts, key = _digest(common.column(batch, "text"))
        fresh = []
        for k, own in enumerate(zip(key[0].to_pylist(), key[1].to_pylist(), strict=True)):
            if len(texts[k]) >= length and own not in seen:
                seen.add(own)
                fresh.append(k)
        take = pa.array(fresh, pa.int64())
        yield pa.RecordBatch.from_arrays([key[0].take(take), key[1].take(take), pa.array([texts[k] for k in fresh], pa.binary())], names=["c1", "c2", "_bytes"])


_CUT_SCHEMA = "h long, s1 long, s2 long, hot boolean, segment binary"


def _cut(batches, length):
    """Segments of needed documents, by their places."""
    last = None
    for batch in batches:
        out = []
        keys = zip(common.column(batch, "c1").to_pylist(), common.column(batch, "c2").to_pylist(), strict=True)
        texts, places = common.column(batch, "_bytes"), common.column(batch, "places")
        for k, key in enumerate(keys):
            if key == last:
                continue
            last = key
            text = texts[k].as_buffer()
            for place in places[k].as_py():
                out.append((place["h"], place["s1"], place["s2"], place["hot"], text.slice(place["lo"], place["m"] + length - 1).to_pybytes()))
                if len(out) >= 20_000:
                    yield _cut_batch(out)
                    out = []
        if out:
            yield _cut_batch(out)


def _cut_batch(rows):
    h, s1, s2, hot, segment = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(hot, pa.bool_()), pa.array(segment, pa.binary())], names=["h", "s1", "s2", "hot", "segment"])


_RANGE_SCHEMA = "s1 long, s2 long, low long, high long"


def _sorted_ranges(batches, length):
    """Repeated starts of segments that come sorted by bucket."""
    held: dict[tuple[int, int], bytes] = {}
    size, bucket = 0, None

    def close():
        keys = list(held)
        rows = [(*k, low, high) for k, flags in zip(keys, repeated_starts(list(held.values()), length), strict=True) for low, high in runs(flags)]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["s1", "s2", "low", "high"])

    for batch in batches:
        columns = [common.column(batch, c).to_pylist() for c in ("h", "s1", "s2")]
        for h, s1, s2, segment in zip(*columns, common.column(batch, "segment"), strict=True):
            if h != bucket:
                if size >= SORT_BYTES:
                    yield close()
                    held, size = {}, 0
                bucket = h
            if (s1, s2) not in held:
                held[s1, s2] = segment.as_py()
                size += len(held[s1, s2])
    if held:
        yield close()


def _window_digests(batches, length):
    for batch in batches:
        for s1, s2, segment in zip(common.column(batch, "s1").to_pylist(), common.column(batch, "s2").to_pylist(), common.column(batch, "segment"), strict=True):
            view = memoryview(segment.as_py())
            found = digests(view[k : k + length] for k in range(len(view) - length + 1))
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, s1)), pa.array(np.full(n, s2)), pa.array(np.arange(n)), pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))],
                names=["s1", "s2", "low", "w1", "w2"],
            )


def _repeated_windows(batches, length, held):
    """Ranges of a segment's starts whose strings have one of the ``held`` digests (two sorted arrays)."""
    first, second = held.value
    for batch in batches:
        out = []
        for s1, s2, segment in zip(common.column(batch, "s1").to_pylist(), common.column(batch, "s2").to_pylist(), common.column(batch, "segment"), strict=True):
            view = memoryview(segment.as_py())
            found = digests(view[k : k + length] for k in range(len(view) - length + 1))
            low, high = np.searchsorted(first, found[:, 0], "left"), np.searchsorted(first, found[:, 0], "right")
            again = np.array([x < y and bool((second[x:y] == d).any()) for x, y, d in zip(low.tolist(), high.tolist(), found[:, 1].tolist(), strict=True)])
            out += [(s1, s2, a, b) for a, b in runs(again)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["s1", "s2", "low", "high"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT_SEGMENTS, gram: int = GRAM) -> DataFrame:
    """(c1, c2, ranges): for each distinct text that has any, the ranges of repeated starts.

    Tables that meet others in a join are written first: only a join of plain tables can be split where
    a bucket, a content or a segment is hot.
    """
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select("text")
    n = common.partitions(spark)
    anchors = common.materialise(texts.mapInArrow(lambda b: _anchors(b, length, gram), "h long, s1 long, s2 long, c1 long, c2 long, lo long, m long, n long"), "anchors")
    # a bucket of one segment, once, holds nothing repeated; most are such
    several = common.materialise(anchors.groupBy("h").agg(F.sum("n").alias("_k")).where("_k > 1").select("h"), "several")
    anchors = common.materialise(anchors.join(several, "h"), "candidates")
    kinds = anchors.groupBy("h", "s1", "s2").agg(F.sum("n").alias("n"), F.max("m").alias("m"), F.max("c1").alias("c1"), F.max_by("c2", "c1").alias("c2"), F.max_by("lo", "c1").alias("lo"))
    kinds = common.materialise(kinds, "segments")
    mixed = common.materialise(kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "mixed")
    wanted = kinds.join(mixed, "h").select("c1", "c2", F.struct("lo", "m", "h", "s1", "s2", (F.col("k") > hot).alias("hot")).alias("place"))
    wanted = common.materialise(wanted.groupBy("c1", "c2").agg(F.collect_list("place").alias("places")), "wanted")
    whole = texts.mapInArrow(lambda b: _distinct(b, length), "c1 long, c2 long, _bytes binary")
    cut = common.materialise(whole.join(wanted, ["c1", "c2"]).mapInArrow(lambda b: _cut(b, length), _CUT_SCHEMA), "cut")
    found = cut.where("not hot").select("h", "s1", "s2", "segment").repartition(n, "h").sortWithinPartitions("h").mapInArrow(lambda b: _sorted_ranges(b, length), _RANGE_SCHEMA)
    many = common.materialise(cut.where("hot").dropDuplicates(["s1", "s2"]).select("s1", "s2", "segment"), "hot")
    windows = many.mapInArrow(lambda b: _window_digests(b, length), "s1 long, s2 long, low long, w1 long, w2 long")
    twice = common.materialise(windows.groupBy("w1", "w2").agg(F.count("*").alias("_k")).where("_k > 1").select("w1", "w2"), "twice")
    if twice.count() <= BROADCAST_WINDOWS:  # few distinct strings, however often each occurs
        table = twice.orderBy("w1").toArrow()
        held = spark.sparkContext.broadcast((table["w1"].to_numpy(), table["w2"].to_numpy()))
        counted = many.mapInArrow(lambda b: _repeated_windows(b, length, held), _RANGE_SCHEMA)
    else:
        counted = common.materialise(windows, "windows").join(twice, ["w1", "w2"]).select("s1", "s2", "low", (F.col("low") + 1).alias("high"))
    copied = kinds.where("n > 1").select("s1", "s2", F.lit(0).cast("long").alias("low"), F.col("m").alias("high"))
    ranges = common.materialise(copied.unionByName(found).unionByName(counted), "ranges")
    placed = anchors.select("s1", "s2", "c1", "c2", "lo").join(ranges, ["s1", "s2"])
    placed = placed.select("c1", "c2", F.struct((F.col("lo") + F.col("low")).alias("low"), (F.col("lo") + F.col("high")).alias("high")).alias("range"))
    return common.materialise(placed.groupBy("c1", "c2").agg(F.collect_set("range").alias("ranges")), "spans")


def removed_spans(ranges, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans that repeated starts in half-open ranges cover."""
    spans: list[list[int]] = []
    for low, high in sorted(ranges):
        high += length - 1
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [(a, b) for a, b in spans]


def whole_words(text: bytes, low: int, high: int) -> int:
    """Words of ``text`` that lie within ``low .. high`` from end to end; in scripts without spaces each character is one."""
    inside = text[low:high].split()
    if not inside:
        return 0
    sizes = [unspaced.word_count(word) for word in (inside[0], inside[-1])]
    count = sum(map(unspaced.word_count, inside)) if unspaced.LEADS.search(text, low, high) else len(inside)
    # a word that goes on beyond an end is not whole; in a script without spaces it goes on as other words
    cut = [low and not text[low - 1 : low].isspace() and not text[low : low + 1].isspace(), high < len(text) and not text[high - 1 : high].isspace() and not text[high : high + 1].isspace()]
    return count - sum(bool(c) and size == 1 for c, size in zip(cut, sizes, strict=True))


def _remove(batches, passed, length, least_words):
    for batch in batches:
        texts, lists = common.column(batch, "_bytes"), common.column(batch, "ranges")
        kept, removed, many = [], [], []
        for k in range(batch.num_rows):
            text = texts[k].as_py() or b""
            found = lists[k].as_py()
            spans = removed_spans([(r["low"], r["high"]) for r in found], length) if found else []
            if least_words:
                spans = [(low, high) for low, high in spans if whole_words(text, low, high) >= least_words]
            parts, at = [], 0
            for low, high in spans:
                parts.append(text[at:low])
                at = high
            kept.append(b"".join([*parts, text[at:]]) if spans else text)
            removed.append(sum(b - a for a, b in spans))
            many.append(len(spans))
        yield pa.RecordBatch.from_arrays(
            [*(common.column(batch, c) for c in passed), pa.array([len(t) + r for t, r in zip(kept, removed, strict=True)], pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()), pa.array(kept, pa.binary())],
            names=[*passed, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, passed: list[str], length: int = LENGTH, hot: int = HOT_SEGMENTS, gram: int = GRAM, least_words: int = 0) -> DataFrame:
    """``passed`` columns, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    With ``least_words`` only maximal runs go that hold so many whole words at least. A passed column that
    is called like a result stands beside it, under the same name.
    """
    spans = repeated_spans(docs, length, hot, gram)
    inside = [f"_in{k}" for k in range(len(passed))]
    source = docs.select(*[F.col(c).alias(i) for c, i in zip(passed, inside, strict=True)], F.col("text").alias("text"))
    kinds = source.select(*inside).schema
    keyed = source.mapInArrow(lambda b: _keyed(b, inside), source.select(*inside).schema.add("c1", "long").add("c2", "long").add("_bytes", "binary"))
    results = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary"}
    for name, kind in results.items():
        kinds = kinds.add(name, kind)
    found = keyed.join(spans, ["c1", "c2"], "left").mapInArrow(lambda b: _remove(common.slices(b, "_bytes"), inside, length, least_words), kinds)
    return found.toDF(*passed, *results)
