"""Queries over the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, importance, language_id, lexical, packing, simhash_dedup, suffix_dedup, token_count, token_output, topk, toxicity, url_filter


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.PAGE_RULES, "host string, path string, verdict string")
    return url_filter.apply_rules(table(spark, sf_dir, "pages"), rules)


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), "spans")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.r <> c.r
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_output.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), token_output.token_folder(spark))
    return token_output.read_tokens(spark, folder)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE steps(v, k, c) AS (
  SELECT v, 0, v FROM range(256) t(v)
  UNION ALL
  SELECT v, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY v) AS crc FROM steps WHERE k = 8
), texts AS (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT side, r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), features AS (
  SELECT side, r, unnest(w) AS feature FROM words
  UNION ALL
  SELECT side, r, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM words WHERE len(w) > 1
), distinct_features AS (
  SELECT DISTINCT feature, hex(encode(feature)) AS h FROM features
), buckets AS (
  SELECT feature,
         xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM distinct_features, crc_table
), cells AS (
  SELECT side, r, bucket, CAST(count(*) AS BIGINT) AS n FROM features JOIN buckets USING (feature) GROUP BY ALL
), sums AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 's'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 't'), 0) AS DOUBLE) AS t FROM cells GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM sums, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums)
), weighed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM cells JOIN gains USING (bucket) WHERE side = 's' GROUP BY r
), scored AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce(total // n_features - CAST(total % n_features < 0 AS BIGINT), 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM words LEFT JOIN weighed USING (r) WHERE side = 's'
), noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, 25 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS drawn FROM noisy
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH lower_texts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), items AS (
  SELECT DISTINCT item_id, r, unnest(terms) AS term FROM (
    SELECT item_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM benchmark)
), sizes AS (
  SELECT doc_id, r, CAST(len(terms) AS BIGINT) AS n FROM lower_texts WHERE len(terms) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), counted AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM lower_texts)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term, docs
), postings AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)) AS share
  FROM counted JOIN sizes USING (r), totals
), scored AS (
  SELECT i.r AS i, item_id, p.r, doc_id, CAST(sum(w * share) AS BIGINT) AS score
  FROM items i JOIN postings p USING (term) JOIN weights USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    whole = byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])
    return whole.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_count": op5_token_count,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_token_output": op9_token_output,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL = {
    "op2_url_filter": OP2_SQL,
    "op6_topk": OP6_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
}
