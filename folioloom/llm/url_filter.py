"""URL filter: host and path rules applied by a sort-merge range join.

A host is written with its labels reversed (``www.example.com`` -> ``com.example.www.``).
All hosts under a rule's host then lie in one interval of that key: those that begin with
the rule's key. Urls are range partitioned and sorted by the key; each task sweeps its sorted
urls beside the sorted rules and keeps a stack of the nested rule hosts that are active.
The paths of a stacked host are tried from the longest to the shortest.

Defined results: a null url, or one without ``://``, has an empty host and an empty path; no
rule fits it. An empty path begins with no rule path but the empty one. Among fitting rules the
one with most characters (host and path) wins, ties go to the longer host, then to the larger
rule text. Where no rule fits, ``rule`` is null and the verdict is ``default``. Repeated rows
each get a row, urls of any length are read whole, empty tables give empty results, further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rules up to this many bytes are broadcast; larger rule tables are dealt out by interval.
BROADCAST_BYTES = 8 << 20

PAGE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``, both empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumns({"host": F.translate(host, upper, lower), "path": path})


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def reversed_host_column(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Sweep:
    """Active rules at the present key of a sorted scan.

    ``rules`` are (key, host, path, verdict) in byte order of the key. The stack holds
    [key, list of its rules]; each entry's key begins with the key of the entry below.
    """

    def __init__(self, rules):
        groups: dict[bytes, list] = {}
        for key, host, path, verdict in rules:
            groups.setdefault(key.encode(), []).append((path, host + path, verdict, len(host)))
        for paths in groups.values():
            paths.sort(key=lambda r: (-len(r[0]), r[1]))
        self.keys = sorted(groups)
        self.groups = groups
        self.next = 0
        self.stack: list[tuple[bytes, list]] = []
        self.last: bytes | None = None

    def at(self, key: bytes) -> list:
        """Move to ``key``, which is not before the last one, and return the stack."""
        if key != self.last:
            while self.next < len(self.keys) and self.keys[self.next] <= key:
                entry = self.keys[self.next]
                while self.stack and not entry.startswith(self.stack[-1][0]):
                    self.stack.pop()
                self.stack.append((entry, self.groups[entry]))
                self.next += 1
            while self.stack and not key.startswith(self.stack[-1][0]):
                self.stack.pop()
            self.last = key
        return self.stack

    def match(self, key: bytes, path: str):
        best = None
        for _, rules in self.at(key):
            for rule_path, text, verdict, host_length in rules:
                if path.startswith(rule_path):
                    score = (len(text), host_length, text)
                    if best is None or score > best[0]:
                        best = (score, text, verdict)
                    break
        return best


def _sweep_batches(batches: Iterator[pa.RecordBatch], sweep: Sweep, default: str, out_schema: pa.Schema):
    for batch in batches:
        keys, paths = common.column(batch, "_key").to_pylist(), common.column(batch, "path").to_pylist()
        found = [sweep.match(key.encode(), path) for key, path in zip(keys, paths, strict=True)]
        columns = {
            "rule": pa.array([f[1] if f else None for f in found], pa.string()),
            "verdict": pa.array([f[2] if f else default for f in found], pa.string()),
        }
        yield pa.RecordBatch.from_arrays(
            [columns.get(field.name, None) if field.name in columns else common.column(batch, field.name).cast(field.type) for field in out_schema],
            schema=out_schema,
        )


def _dealt_batches(batches: Iterator[pa.RecordBatch], default: str, out_schema: pa.Schema):
    """As _sweep_batches, for rows of rules and urls that come sorted by (part, key, kind)."""
    part, rules, sweep = None, [], None
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for row in rows:
            if row["_part"] != part:
                part, rules, sweep = row["_part"], [], None
            if row["_kind"] == 0:
                rules.append((row["_rule_key"], row["host"], row["path"], row["_verdict"]))
                continue
            if sweep is None:
                sweep = Sweep(rules)
            found = sweep.match(row["_key"].encode(), row["path"])
            out.append({**{f.name: row.get(f.name) for f in out_schema}, "rule": found[1] if found else None, "verdict": found[2] if found else default})
        yield pa.RecordBatch.from_pylist(out, schema=out_schema)


def apply_rules(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: ``key, host, path, rule, verdict``.

    ``rules`` has columns host, path, verdict; a rule with a null among them is ignored. Hosts are compared with A-Z
    lower-cased. Of rules of one host and path that disagree, block holds, else the least verdict.
    """
    spark = pages.sparkSession
    common.ship(spark)
    key_type = pages.schema[key].dataType
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy(low.alias("host"), "path")
    rules = known.agg(F.coalesce(F.max(F.when(F.col("verdict") == "block", "block")), F.min("verdict")).alias("verdict"))
    rules = rules.select("host", "path", "verdict", reversed_host_column(F.col("host")).alias("key"))
    urls = url_parts(pages.select(key, url), url).select(key, "host", "path", reversed_host_column(F.col("host")).alias("_key"))
    # a hot host is cut by path and page as well, so that no range holds it whole
    ranged = urls.repartitionByRange(common.partitions(spark), "_key", "path", key)
    schema = pages.select(key).schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")
    arrow = pa.schema([pa.field(key, _arrow_type(key_type)), *(pa.field(n, pa.string()) for n in ("host", "path", "rule", "verdict"))])
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.lit(64))).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([(r["key"], r["host"], r["path"], r["verdict"]) for r in rules.collect()])

        def run(batches):
            yield from _sweep_batches(batches, Sweep(held.value), default, arrow)

        return ranged.sortWithinPartitions("_key").mapInArrow(run, schema)
    # The rules do not fit: each goes to the ranges that its interval meets.
    parted = common.materialise(ranged.withColumn("_part", F.spark_partition_id()), "urls")
    bounds = parted.groupBy("_part").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    ruled = rules.join(F.broadcast(bounds), (F.col("key") <= F.col("_high")) & (F.concat(F.col("key"), F.lit("\U0010ffff")) >= F.col("_low")))
    both = parted.withColumns({"_kind": F.lit(1), "_rule_key": F.lit(None).cast("string"), "_verdict": F.lit(None).cast("string")}).unionByName(
        ruled.select(F.lit(None).cast(key_type).alias(key), "host", "path", F.lit("").alias("_key"), "_part", F.lit(0).alias("_kind"), F.col("key").alias("_rule_key"), F.col("verdict").alias("_verdict"))
    )
    return both.repartition(common.partitions(spark), "_part").sortWithinPartitions("_part", "_kind", "_key").mapInArrow(lambda batches: _dealt_batches(batches, default, arrow), schema)


def _arrow_type(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)
