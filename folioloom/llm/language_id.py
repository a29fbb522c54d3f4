"""Language identification with a string kernel.

Two texts are compared by a blended-spectrum presence kernel: the number of character n-grams
(1 to 4, lower-cased, other characters than letters folded into one boundary) that both have,
divided by the root of the product of their own numbers. A Nyström map over landmark texts
approximates the kernel, and one-versus-rest kernel ridge regression is solved in it.

Only n-grams of the landmarks can add to a kernel value, so a batch of texts becomes a presence
matrix over these; its product with the landmarks' matrix gives all kernel values, and a second
product all languages' outputs. The score is the winner's output mapped from [-1, 1] to [0, 1].

The fit takes a bounded sample: ``SAMPLE`` texts over all languages, evenly (``LEAST_TEXTS`` of a language at least),
chosen by a hash of doc_id, of each its first ``SAMPLE_CHARS`` characters, fewer where there are so many
languages that the sample would pass ``SAMPLE_TOTAL`` characters. Of labels the ``MAX_LANGUAGES`` most frequent are
learned, more than there are languages, so that a label column of other contents cannot flood the
driver. Prediction reads every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text
if there is nothing to learn from. A text with letters but no n-gram in common with any landmark gets
the language that is likeliest beforehand, with score 0. Rows with
a null doc_id are neither learned from nor held out. Repeated rows each get a row (in the sample, equal texts of a
language count once where they meet); very long texts are read whole, in parts; an empty table gives an empty table;
further columns are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, LEAST_TEXTS = 1600, 4
SAMPLE_CHARS, SAMPLE_TOTAL = 32 << 10, 56 << 20
MAX_LANGUAGES = 8192
#: Landmarks: one of each language at least, up to ``MOST_LANDMARKS``.
LANDMARKS, MOST_LANDMARKS = 128, 1024
LANDMARK_BYTES = 4096
ORDERS = (1, 2, 3, 4)
SPACE_BITS = 21
RIDGE = 0.3
UNDETERMINED = "und"
#: Texts in a presence matrix, and cells up to which the matrices are dense.
BATCH_ROWS = 128
DENSE_CELLS = 1 << 24
#: Characters of a text that are taken at once, and shared by neighbouring parts at least; for memory only.
PART, OVERLAP = 1 << 18, 64
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the row of each, and whether each text has a letter."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    pad = np.zeros(1, np.uint32)
    lengths = np.array([len(p) + 2 for p in points])
    whole = np.concatenate([x for p in points for x in (pad, p, pad)]) if points else pad
    row = np.repeat(np.arange(len(points), dtype=np.int64), lengths)
    kind = letters()[whole]
    has = np.bincount(row[kind], minlength=len(points)) > 0
    value = np.where(kind, whole, 0).astype(np.uint64)
    keep = np.r_[True, kind[1:] | kind[:-1] | (row[1:] != row[:-1])]  # a run of other characters counts once
    value, row = value[keep], row[keep]
    codes, rows = [], []
    for order in ORDERS:
        if len(value) < order:
            continue
        n = len(value) - order + 1
        mixed = np.full(n, order, dtype=np.uint64)
        for k in range(order):
            mixed = (mixed ^ value[k : k + n]) * _MULTIPLIERS[k]
            mixed ^= mixed >> np.uint64(29)
        inside = row[:n] == row[order - 1 :]
        if order == 1:  # the boundary alone says nothing
            inside &= value > 0
        codes.append(((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SPACE_BITS)).astype(np.int64)[inside])
        rows.append(row[:n][inside])
    return np.concatenate(codes), np.concatenate(rows), has


def parts(text: str) -> list[str]:
    """The text, or overlapping parts of a very long one; they begin and end at white space where it has any."""
    out, at = [], 0
    while len(text) - at > PART:
        end = max(text.rfind(" ", at + PART // 2, at + PART), text.rfind("\n", at + PART // 2, at + PART))
        end = end if end > 0 else at + PART
        out.append(text[at:end])
        back = max(text.rfind(" ", at, end - OVERLAP), text.rfind("\n", at, end - OVERLAP))
        at = back if back > at else end - OVERLAP
    return [*out, text[at:]]


class Model:
    """N-grams of landmarks and regression weights; arrays only, so that it can be broadcast.

    slot: number of each n-gram hash among the landmarks' n-grams; grams: (n-gram, landmark) pairs, in order;
    size: n-grams of each landmark.
    """

    def __init__(self, languages, slot, grams, size, weights, bias):
        self.languages, self.slot, self.grams, self.size, self.weights, self.bias = languages, slot, grams, size, weights, bias
        self.n_grams = int(grams[0].max()) + 1 if len(grams[0]) else 0
        self.first = np.searchsorted(grams[0], np.arange(self.n_grams + 1))
        self.landmarks = None

    def __getstate__(self):
        return self.__dict__ | {"landmarks": None}

    @property
    def dense(self) -> bool:
        return self.n_grams * max(len(self.size), BATCH_ROWS) <= DENSE_CELLS

    def pairs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and landmarks' n-grams of texts, as they occur, in turns that bound memory; and the rows with a letter."""
        owner, held = [], []

        def found():
            codes, rows, letter = gram_codes(held)
            place = np.array(owner)
            slots = self.slot[codes]
            known = slots >= 0
            return place[rows[known]], slots[known], place[letter]

        for k, text in enumerate(texts):
            for part in parts(text):
                owner.append(k)
                held.append(part)
                if len(text) > PART:
                    yield found()
                    owner, held = [], []
        if held:
            yield found()

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams each text has, as a matrix, and which texts have a letter."""
        matrix, has = np.zeros((len(texts), self.n_grams), dtype=np.float32), np.zeros(len(texts), dtype=bool)
        for rows, slots, letters_in in self.pairs(texts):
            matrix[rows, slots] = 1.0
            has[letters_in] = True
        return matrix, has

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kernel values with all landmarks, which texts have any n-gram of them, and which have a letter."""
        n = len(texts)
        if self.dense:
            if self.landmarks is None:
                self.landmarks = np.zeros((self.n_grams, len(self.size)), dtype=np.float32)
                self.landmarks[self.grams] = 1.0
            matrix, has = self.presence(texts)
            own, shared = matrix.sum(axis=1), matrix @ self.landmarks
        else:  # the same product, over the landmarks of each n-gram
            has, seen = np.zeros(n, dtype=bool), [np.zeros(0, np.int64)]
            for rows, slots, letters_in in self.pairs(texts):
                has[letters_in] = True
                seen.append(np.unique(rows * self.n_grams + slots))
            rows, slots = np.divmod(np.unique(np.concatenate(seen)), max(1, self.n_grams))
            own = np.bincount(rows, minlength=n)
            many = self.first[slots + 1] - self.first[slots]
            landmark = self.grams[1][common.ragged(self.first[slots], many)]
            shared = np.bincount(np.repeat(rows, many) * len(self.size) + landmark, minlength=n * len(self.size)).reshape(n, -1).astype(np.float32)
        return shared / np.sqrt(np.maximum(own, 1.0)[:, None] * self.size), own > 0, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for at in range(0, len(texts), BATCH_ROWS):
            kernel, some, has = self.kernel([t or "" for t in texts[at : at + BATCH_ROWS]])
            out = kernel @ self.weights + self.bias
            best = out.argmax(axis=1)
            names += [self.languages[b] if letter else UNDETERMINED for b, letter in zip(best, has, strict=True)]
            scores.append(np.where(has & some, np.clip((out[np.arange(len(best)), best] + 1) / 2, 1e-9, 1), 0.0))  # 0 says that nothing spoke for it
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """Fit on texts in a fixed order; None if there are none with a letter."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(label) for label in labels])
    # landmarks: languages in turn, texts of middling length first come first
    order = []
    queues = [[k for k in np.flatnonzero(y == c) if 200 <= len(texts[k].encode()) <= LANDMARK_BYTES] or list(np.flatnonzero(y == c)) for c in range(len(languages))]
    while len(order) < LANDMARKS and any(queues):
        order += [q.pop(0) for q in queues if q]
    longest = max(1, LANDMARKS * LANDMARK_BYTES // max(LANDMARKS, len(languages)))
    chosen = [texts[k][:longest] for k in order[: min(MOST_LANDMARKS, max(LANDMARKS, len(languages)))]]
    codes, rows, _ = gram_codes(chosen)
    vocabulary, inverse = np.unique(codes, return_inverse=True)
    slot = np.full(1 << SPACE_BITS, -1, dtype=np.int32)
    slot[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    pairs = np.unique(inverse.astype(np.int64) * len(chosen) + rows)
    grams = (pairs // len(chosen), pairs % len(chosen))
    size = np.maximum(np.bincount(grams[1], minlength=len(chosen)), 1).astype(np.float32)
    model = Model(languages, slot, grams, size, None, None)
    cross = np.concatenate([model.kernel(texts[k : k + BATCH_ROWS])[0] for k in range(0, len(texts), BATCH_ROWS)]).astype(np.float64)
    inner = np.concatenate([model.kernel(chosen[k : k + BATCH_ROWS])[0] for k in range(0, len(chosen), BATCH_ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = cross @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    bias, centre = target.mean(axis=0), features.mean(axis=0)
    moved = features - centre
    solved = np.linalg.solve(moved.T @ moved + RIDGE * np.eye(moved.shape[1]), moved.T @ (target - bias))
    model.weights = (root @ solved).astype(np.float32)
    model.bias = (bias - centre @ solved).astype(np.float32)
    return model


def sample(docs: DataFrame, held_out) -> list:
    """(text, lang) rows to learn from, bounded as the module says."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return []
    each = max(LEAST_TEXTS, SAMPLE // len(counts))
    chars = min(SAMPLE_CHARS, SAMPLE_TOTAL // (each * len(counts)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30))
    # more than enough by chance; ranked then, so that no more than twice ``each`` come to the driver
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (each + 4 * each**0.5 + 8) / r["count"]) * (1 << 30))) for r in counts], "lang string, _share long")
    drawn = usable.select(F.col("lang").cast("string").alias("lang"), F.substring("text", 1, chars).alias("text"), draw.alias("draw"))
    drawn = drawn.join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("_share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    rows = drawn.withColumn("_place", place).where(F.col("_place") <= 2 * each).select("text", "lang", "draw").collect()
    taken: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        own = taken.setdefault(row["lang"], [])
        if len(own) < each and (not own or own[-1] != row["text"]):
            own.append(row["text"])
    # in turn, so that landmarks and blocks mix languages
    return [(text, lang) for lang in sorted(taken) for text in taken[lang]]


def train(docs: DataFrame, held_out=None) -> Model | None:
    rows = sample(docs, held_out if held_out is not None else F.lit(False))
    return fit([t for t, _ in rows], [lang for _, lang in rows]) if rows else None


def _predict(batches, held, passed):
    model = held.value
    for batch in common.slices(batches, "text", 1 << 19):
        texts = common.column(batch, "text").to_pylist()
        names, scores = model.predict(texts) if model else ([UNDETERMINED] * len(texts), np.zeros(len(texts)))
        yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in passed), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*passed, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None, passed: list[str]) -> DataFrame:
    """``passed`` columns (text among them if wanted), lang_pred and score of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    held = spark.sparkContext.broadcast(model)
    schema = docs.select(*passed).schema.add("lang_pred", "string").add("score", "double")
    source = docs.select(*passed) if "text" in passed else docs.select(*passed, "text")
    return source.mapInArrow(lambda batches: _predict(batches, held, passed), schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that are not held out."""
    bucket = common.crc_bucket(F.col("doc_id"), 3)
    held_out = F.coalesce(bucket == 1, F.lit(False))
    model = train(docs, held_out)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
