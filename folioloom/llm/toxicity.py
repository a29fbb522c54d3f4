"""Toxicity scores from a linear-chain conditional random field over tokens.

Labels are given per document. Token labels come from them: a token of a toxic document is labelled
toxic if a feature of it (the word, its beginnings and endings) is tied to toxic documents by a
likelihood-ratio test; all tokens of other documents are labelled clean. The CRF has two tags,
hashed word features and tag transitions, and is fitted by AdaGrad on the token likelihood.

With two tags the forward and backward messages reduce to one ratio each, which runs over all
texts of a batch in step. The token marginals give the document score (a logistic function
of the greatest and the summed marginal, fitted on the same rows) and the toxic spans: character
offsets of maximal runs of tokens whose marginal is at least one half.

The fit takes a bounded sample of labelled rows: ``SAMPLE`` documents per class of those that documents has, chosen by
a hash of doc_id, those of at most ``SAMPLE_CHARS`` characters first, each read whole; of near copies with one label the first
counts. Scoring reads every whole text.

Defined results: null, empty and wordless texts have no token and the score of no evidence; a
doc_id with several labels counts as toxic if any of them says so; null labels and null doc_ids are
not learned from, and a null doc_id is not held out; of rows that share a doc_id the one of the least text hash is
learned from. Without a row of each class the score is the share of toxic rows, 0 without rows. Repeated
rows each get a row; a very long text is scored whole, in memory by its length; an empty table gives an empty table;
further columns are left out.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import common

#: Documents of each class that the fit takes; longer ones than SAMPLE_CHARS only where shorter ones are too few, of these
#: MOST_LONG at most, and none over LONG_CHARS: the bounds of the driver's sample. Each is read whole, as its label is.
SAMPLE = 2000
SAMPLE_CHARS, LONG_CHARS, MOST_LONG = 32 << 10, 1 << 20, 50
#: Jaccard similarity of word sets from which two texts of one label are copies of each other.
COPY = 0.8
FEATURE_BITS = 18
#: Twice the log-likelihood ratio from which a feature marks tokens as toxic, and its least documents.
EVIDENCE = 30.0
EPOCHS = 25
CACHE_WORDS = 600_000
WORD = re.compile(r"[^\W_]+")
_LIMIT = 30.0
SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()))


def tokens(text: str) -> list[str]:
    """Lower-cased words of a text."""
    low = text.lower()
    # lower case may be longer; then places would not be those of the text
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: the word, beginnings of 3-6, endings of 3-5 letters."""
    mask = (1 << FEATURE_BITS) - 1
    names = ["w" + word, *("b" + word[:k] for k in (3, 4, 5, 6) if len(word) >= k), *("e" + word[-k:] for k in (3, 4, 5) if len(word) >= k)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]


class Steps:
    """Texts of a batch laid out step by step: all first tokens, all second tokens, ..."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        longest = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(longest), side="left")
        self.offset = np.r_[0, np.cumsum(self.active)]
        starts = (np.cumsum(lengths) - lengths)[self.order]
        step = np.repeat(np.arange(longest), self.active)
        place = np.arange(int(self.offset[-1])) - self.offset[step]
        self.token = starts[place] + step

    def odds(self, emission: np.ndarray, start: float, enter: float, leave: float, stay: float):
        """Forward ratios, backward ratios and emission factors, in step layout.

        The weights are of the tag pairs clean-toxic, toxic-clean and toxic-toxic (clean-clean is 1).
        """
        factor = np.exp(np.clip(emission[self.token], -_LIMIT, _LIMIT))
        forward = np.empty_like(factor)
        backward = np.ones_like(factor)
        bounds = self.offset.tolist()
        if len(self.active):
            forward[: bounds[1]] = factor[: bounds[1]] * start
        for t in range(1, len(self.active)):
            low, high = bounds[t], bounds[t + 1]
            before = forward[bounds[t - 1] : bounds[t - 1] + high - low]
            forward[low:high] = factor[low:high] * (enter + stay * before) / (1.0 + leave * before)
        for t in range(len(self.active) - 1, 0, -1):
            low, high = bounds[t], bounds[t + 1]
            after = factor[low:high] * backward[low:high]
            backward[bounds[t - 1] : bounds[t - 1] + high - low] = (leave + stay * after) / (1.0 + enter * after)
        return forward, backward, factor

    def marginals(self, emission, start, enter, leave, stay) -> np.ndarray:
        """Probability of the toxic tag for each token, in token order."""
        forward, backward, _ = self.odds(emission, start, enter, leave, stay)
        odds = forward * backward
        out = np.empty_like(odds)
        out[self.token] = odds / (1.0 + odds)
        return out


class Model:
    def __init__(self, weights: np.ndarray, transitions: tuple, document: np.ndarray, constant: float | None = None):
        self.weights, self.transitions, self.document, self.constant = weights, transitions, document, constant
        self.emission: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"emission": {}}

    def word_emissions(self, words: list[str]) -> np.ndarray:
        known = self.emission
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list(set(words).difference(known))
        if new:
            ids = [features(w) for w in new]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for own in ids for i in own), np.int64, int(counts.sum()))
            sums = np.add.reduceat(self.weights[flat], np.cumsum(counts) - counts) + self.weights[-1]
            known.update(zip(new, sums.tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def token_marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, lengths = [], []
        for text in texts:
            own = tokens(text)
            words += own
            lengths.append(len(own))
        lengths = np.array(lengths, dtype=np.int64)
        return Steps(lengths).marginals(self.word_emissions(words), *self.transitions), lengths

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Document scores and, for each text, its toxic spans."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), [[] for _ in texts]
        marginals, lengths = self.token_marginals(texts)
        scores = sigmoid(evidence(marginals, lengths) @ self.document)
        ends = np.cumsum(lengths)
        toxic = marginals >= 0.5
        hits = np.diff(np.r_[0, np.cumsum(toxic)][np.r_[0, ends]])
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        for k in np.flatnonzero(hits):
            own = toxic[ends[k] - lengths[k] : ends[k]]
            found = [m.span() for m in WORD.finditer(texts[k])]
            last = -2
            for at in np.flatnonzero(own).tolist():
                if at == last + 1:
                    spans[k][-1] = (spans[k][-1][0], found[at][1])
                else:
                    spans[k].append(found[at])
                last = at
        return scores, spans


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -_LIMIT, _LIMIT)))


def evidence(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text: 1, its greatest marginal, log of 1 + its summed marginals."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1.0
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some, 1] = np.maximum.reduceat(marginals, starts)
        out[some, 2] = np.log1p(np.add.reduceat(marginals, starts))
    return out


def _toxic_features(flat, starts, counts, token_type, lengths, toxic_doc) -> np.ndarray:
    """Marks the features that toxic documents have far more often than others."""
    size = 1 << FEATURE_BITS
    k1, k0 = np.zeros(size), np.zeros(size)
    at = 0
    for n, toxic in zip(lengths.tolist(), toxic_doc.tolist(), strict=True):  # a document at a time, for memory
        kinds = np.unique(token_type[at : at + n])
        (k1 if toxic else k0)[np.unique(flat[common.ragged(starts[kinds], counts[kinds])])] += 1
        at += n
    n1, n0 = toxic_doc.sum(), (~toxic_doc).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (k1 + k0) / (n1 + n0)
        ratio = sum(np.where(o > 0, o * np.log(o / e), 0.0) for o, e in ((k1, n1 * share), (k0, n0 * share), (n1 - k1, n1 * (1 - share)), (n0 - k0, n0 * (1 - share))))
    # a sign of toxicity: hardly seen elsewhere
    return (2 * ratio >= EVIDENCE) & (k1 / n1 > 8 * (k0 + 0.5) / n0)


def _first_of_copies(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Indices of texts that are no near copies of an earlier one of the same label.

    Only texts with the same three least word hashes are compared, so this spares some copies, and drops nothing else.
    """
    kept: dict[tuple, list[set]] = {}
    first = []
    for k, text in enumerate(texts):
        own = set(tokens(text))
        least = sorted(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own)[:3]
        others = kept.setdefault((bool(toxic[k]), *least), [])
        if not any(len(own & o) >= COPY * len(own | o) for o in others):
            others.append(own)
            first.append(k)
    return np.array(first, dtype=np.int64)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Fit on texts with 0/1 labels; ``weight`` restores the classes' true shares in the score."""
    first = _first_of_copies(texts, toxic)
    texts, toxic, weight = [texts[k] for k in first], toxic[first].astype(bool), weight[first]
    if toxic.all() or not toxic.any():
        return Model(np.zeros(1), (), np.zeros(3), float((weight * toxic).sum() / weight.sum()) if len(toxic) else 0.0)
    kinds: dict[str, int] = {}
    token_type, lengths = array("q"), []
    for text in texts:
        own = tokens(text)
        token_type.extend(kinds.setdefault(w, len(kinds)) for w in own)
        lengths.append(len(own))
    token_type, lengths = np.array(token_type, dtype=np.int64), np.array(lengths, dtype=np.int64)
    n_types = len(kinds)
    counts, numbers = np.zeros(n_types, np.int64), array("q")
    for k, word in enumerate(kinds):
        own = features(word)
        counts[k] = len(own)
        numbers.extend(own)
    flat = np.array(numbers, dtype=np.int64)
    starts = np.cumsum(counts) - counts
    doc_of = np.repeat(np.arange(len(texts)), lengths)
    size = 1 << FEATURE_BITS
    weights = np.zeros(size + 1)
    if not n_types:
        return Model(weights, (1.0, 1.0, 1.0, 1.0), np.zeros(3), float((weight * toxic).sum() / weight.sum()))
    marks = _toxic_features(flat, starts, counts, token_type, lengths, toxic)
    marked = np.add.reduceat(marks[flat].astype(np.int64), starts) > 0
    label = (marked[token_type] & toxic[doc_of]).astype(float)
    steps = Steps(lengths)
    y = label[steps.token]
    weights[-1] = -4.0
    trans = np.array([-2.0, -2.0, 0.0, 0.0])  # logs of: start, enter, leave, stay
    squares, trans_squares = np.full(size + 1, 1e-8), np.full(4, 1e-8)
    first = int(steps.active[0])
    before = np.arange(first, len(y)) - np.repeat(steps.active[:-1], steps.active[1:]) if len(steps.active) > 1 else np.zeros(0, np.int64)
    scale = 1.0 / max(1.0, label.sum())
    for _ in range(EPOCHS):
        emission = (np.add.reduceat(weights[flat], starts) + weights[-1])[token_type]
        start, enter, leave, stay = np.exp(trans)
        forward, backward, factor = steps.odds(emission, start, enter, leave, stay)
        odds = forward * backward
        p = odds / (1.0 + odds)
        gap = p - y
        by_type = np.bincount(token_type[steps.token], gap, minlength=n_types)
        gradient = np.append(np.bincount(flat, np.repeat(by_type, counts), minlength=size), by_type.sum()) * scale + 1e-4 * weights
        after = factor[first:] * backward[first:]
        prior = forward[before]
        total = 1.0 + enter * after + prior * (leave + stay * after)
        ya, yb = y[before], y[first:]
        slope = np.array([
            gap[:first].sum(),
            (enter * after / total - (1 - ya) * yb).sum(),
            (prior * leave / total - ya * (1 - yb)).sum(),
            (prior * stay * after / total - ya * yb).sum(),
        ]) * scale + 1e-4 * trans
        squares += gradient**2
        trans_squares += slope**2
        weights -= 0.5 * gradient / np.sqrt(squares)
        trans -= 0.3 * slope / np.sqrt(trans_squares)
        trans = np.clip(trans, -8, 8)
    emission = (np.add.reduceat(weights[flat], starts) + weights[-1])[token_type]
    transitions = tuple(np.exp(trans).tolist())
    x = evidence(steps.marginals(emission, *transitions), lengths)
    document = np.zeros(3)
    for _ in range(30):  # Newton steps of a weighted, ridged logistic regression
        p = sigmoid(x @ document)
        slope = x.T @ (weight * (p - toxic)) + np.array([0, 0.1, 0.1]) * document
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        document = document - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return Model(weights, transitions, document)


def train(docs: DataFrame, labels: DataFrame, held_out_modulus: int = 5) -> Model:
    """Fit on labelled documents whose id's bucket is not 0."""
    spark = docs.sparkSession
    usable = F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (common.crc_bucket(F.col("doc_id"), held_out_modulus) != 0)
    known = labels.where(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # drawn among the labelled rows that documents has
    known = common.materialise(known.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi"), "labelled")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    size = F.char_length("text")
    fit_for = docs.where(size <= LONG_CHARS)
    sized = common.materialise(known.join(fit_for.groupBy("doc_id").agg(F.min(size > SAMPLE_CHARS).alias("_long")), "doc_id"), "sized")
    chosen = []
    for kind in totals:
        drawn = sized.where(F.col("toxic") == kind).orderBy("_long", F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(SAMPLE).select("doc_id", "_long").collect()
        short = [(r["doc_id"], kind) for r in drawn if not r["_long"]]
        chosen += short + [(r["doc_id"], kind) for r in drawn if r["_long"]][:MOST_LONG]
    if not chosen:
        return fit([], np.zeros(0), np.zeros(0))
    ids = spark.createDataFrame(chosen, known.schema)  # 2 * SAMPLE rows at most
    texts = fit_for.select("doc_id", "text", (size > SAMPLE_CHARS).alias("_long"), F.xxhash64("text").alias("_hash")).join(F.broadcast(ids), "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_long", "_hash"))
    rows = texts.withColumn("_place", place).where("_place = 1").collect()
    found = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in rows})
    toxic = np.array([t for _, _, t in found], dtype=int)
    taken = {kind: max(1, int((toxic == kind).sum())) for kind in totals}
    weight = np.array([totals[t] / taken[t] for t in toxic.tolist()])
    return fit([t for _, t, _ in found], toxic, weight * len(found) / max(weight.sum(), 1e-9))


def _score(batches, held, passed):
    model = held.value
    for batch in common.slices(batches, "text", 3 << 20):
        scores, spans = model.score([t or "" for t in common.column(batch, "text").to_pylist()])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        lists = pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], kind)
        yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in passed), pa.array(scores), lists], names=[*passed, "score", "spans"])


def score(docs: DataFrame, model: Model, passed: list[str]) -> DataFrame:
    """``passed`` columns, score and spans (code point offsets of toxic runs) of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(model)
    schema = docs.select(*passed).schema.add("score", "double").add("spans", SPANS)
    return docs.select(*dict.fromkeys([*passed, "text"])).mapInArrow(lambda batches: _score(batches, held, passed), schema)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans, learned from labels that are not held out."""
    held_out = F.coalesce(common.crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    found = score(docs, train(docs, labels), ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
