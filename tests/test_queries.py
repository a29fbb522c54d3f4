"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import datetime as dt
import re

import duckdb
import pytest

from folioloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str([plain(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    rows = frame.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted(tuple(plain(v) for v in row) for row in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == expected


def test_ngram_phrases(spark, sf_dir):
    got = {r.doc_id: r.phrases for r in registry.QUERIES["ngram_phrases"](spark, sf_dir).collect()}
    marks = dict(zip("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy", strict=True))
    for doc, passage in duckdb.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall():
        plain_text = "".join(marks.get(c, c) for c in passage.lower())
        words = re.findall("[a-z0-9]+", re.sub(r"^#{1,6}\s+|^[_*]+|[_*]+$", "", plain_text.strip()))
        assert got.pop(doc) == len({" ".join(words[k : k + n]) for n in range(1, 13) for k in range(len(words) - n + 1)})
    assert not got


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and "unique_readers" in frame.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
