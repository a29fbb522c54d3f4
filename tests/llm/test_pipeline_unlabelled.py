"""Stages of the pipeline on documents of which no language can be learned."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_without_labels_stay(spark, tmp_path):
    texts = ["an unlabelled text", "ж", "123 !", "", None]
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(texts)], SCHEMA)
    found = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == [0, 1]
