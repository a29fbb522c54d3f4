"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes
every stage's result to the shared folder and reads it back as the next one's documents. All stages
but the last return the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty table; null doc_ids, ties and repeated rows are
documents like others (near_duplicates keeps one row of equal ones); very long texts are read whole, in parts; further
columns pass as they are, whatever they are called, up to the last stage, which leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import common, decontaminate, language_id, near_copies, packing, queries, suffix_dedup

#: Repeated strings are found from so many bytes on, and go if they make a run of so many whole words: over 50.
#: 51 words have more bytes than that in any of the corpus's languages.
REPEAT_BYTES, REPEAT_GRAM, REPEAT_WORDS = 160, 32, 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no determined language: no text, no letter, nothing like any learned language.

    If no language can be learned, documents with a letter stay.
    """
    model = language_id.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    source, names, restored = common.guarded(docs, "text")
    known = language_id.predict(source, model, names)
    return restored(known.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") > 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of texts whose five-word shingles are 0.8 alike or more.

    Candidates link by SimHash fingerprints at three bits, or by MinHash bands, which meet those that differ in more bits.
    """
    return near_copies.deduplicate(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings that repeat anywhere out of the texts; a document with nothing left goes.

    Bytes of a character of which only a part was repeated go as well. ``n_chars`` follows the text.
    """
    found, names, restored = common.guarded(docs, "text", "n_chars")
    passed = [c for c in names if c != "text"]
    found = found.withColumn("_blank", F.col("text").isNull())
    found = suffix_dedup.remove_repeats(found, [*passed, "_blank"], REPEAT_BYTES, gram=REPEAT_GRAM, least_words=REPEAT_WORDS)
    changed = F.col("n_removed") > 0
    kept = found.where((F.octet_length("kept") > 0) | ~changed)
    # a cut character's left-over bytes become U+FFFD, which is then taken out
    cut = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    out = kept.withColumn("text", F.when(changed, cut).when(~F.col("_blank"), F.col("kept").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(out)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage like a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences: a row for each with its documents and ids."""
    return packing.sequences(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", decontamination),
    ("packing", sequences),
]

#: SQL can express neither the language model nor the suffix sorting; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``. A stage's own tables go once its result is written, and so does the result before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = common.made()
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_since(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
