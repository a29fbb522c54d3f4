"""Tables that are served in pages, as a Spark data source named ``pages``.

A page is an offset and a limit. Where the server says how many rows there are, each page is an input partition, beyond
``PARTITIONS`` pages a run of pages is, of which each row group is read in one stream;
where it does not, ``readers`` partitions stride through the pages until each meets a page that is not full. A page
that is short though it is not the last, or too long, means that the table changed under the scan:
the read fails, and nothing incomplete is passed on. ``scan`` also fails if a key stands in two pages.

Two kinds of server: ``path`` names a Parquet file or folder that every worker reaches, of which a page reads only
the row groups that it touches; ``url`` an HTTP address that takes ``limit`` and ``offset`` and answers with a JSON array.
An HTTP answer of 429 or above 499, or none, is asked for again, as ``audit.retry_waits`` has it.

Defined results: an empty table has no page or one empty one; rows without a key are never repeats.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from time import sleep
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a page, attempts of a request, the first wait, the longest, and the longest a server may ask for, in seconds.
PAGE_ROWS = 1000
BATCH_ROWS = 1 << 16
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, LONGEST_ASKED = 5, 0.5, 8.0, 15.0
READERS = 8
#: The most input partitions of a table of known length. Each reads a row group from its beginning: more of them read more twice.
PARTITIONS = 96
#: The clock of this source alone: putting another sleep in its place leaves other threads theirs.
time = SimpleNamespace(sleep=sleep)


class ParquetPages:
    """Pages of the rows of Parquet files, in the order of names and rows."""

    def __init__(self, path: str):
        files, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        found = files.get_file_info(place)
        if found.type == pyarrow.fs.FileType.Directory:
            inside = files.get_file_info(pyarrow.fs.FileSelector(place, recursive=True))
            names = sorted(f.path for f in inside if f.type == pyarrow.fs.FileType.File and f.path.endswith(".parquet"))
        else:
            names = [place]
        self.groups = []  # (file, row group, first row, rows)
        at = 0
        self.files = [pq.ParquetFile(files.open_input_file(name)) for name in names]
        for file in self.files:
            for group in range(file.metadata.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                self.groups.append((file, group, at, n))
                at += n
        self.rows = at

    def total(self) -> int | None:
        return self.rows

    def schema(self) -> StructType:
        return from_arrow_schema(self.files[0].schema_arrow)

    def page(self, number: int, size: int, schema: pa.Schema) -> pa.Table:
        low, high = number * size, (number + 1) * size
        parts = []
        for file, group, first, n in self.groups:
            if first < high and first + n > low:
                whole = file.read_row_group(group, columns=schema.names)
                start = max(0, low - first)
                parts.append(whole.slice(start, min(n, high - first) - start))
        return (pa.concat_tables(parts) if parts else schema.empty_table()).select(schema.names).cast(schema)


    def pages(self, first: int, count: int, size: int, schema: pa.Schema) -> Iterator[pa.Table]:
        """Pages from ``first`` on, in order, as far as there are rows; batches of a row group are held, never all of it."""
        low, high = first * size, min((first + count) * size, self.rows)
        held = schema.empty_table()
        for file, group, at, n in self.groups:
            if at < high and at + n > low:
                for batch in file.iter_batches(max(size, BATCH_ROWS), row_groups=[group], columns=schema.names):
                    start, stop = max(low - at, 0), min(high - at, batch.num_rows)
                    at += batch.num_rows
                    if start < stop:
                        fresh = pa.Table.from_batches([batch.slice(start, stop - start)]).select(schema.names).cast(schema)
                        held = pa.concat_tables([held, fresh])
                    while held.num_rows >= size:
                        yield held.slice(0, size)
                        held = held.slice(size)
                    if at >= high:
                        break
        if held.num_rows:
            yield held


class HttpPages:
    """Pages of a JSON array over HTTP; Content-Range may say how many rows there are."""

    def __init__(self, url: str):
        self.url = url

    def _get(self, limit: int, offset: int) -> tuple[list, str]:
        address = f"{self.url}{'&' if '?' in self.url else '?'}limit={limit}&offset={offset}"
        for attempt in range(1, ATTEMPTS + 1):
            asked = None
            try:
                with urllib.request.urlopen(address, timeout=60) as answer:
                    rows = json.load(answer)
                    if not isinstance(rows, list):
                        raise ValueError(f"{self.url} did not answer with an array")
                    return rows, answer.headers.get("Content-Range") or ""
            except urllib.error.HTTPError as error:
                if attempt == ATTEMPTS or (error.code != 429 and error.code < 500):
                    raise
                asked = error.headers.get("Retry-After")
            except urllib.error.URLError:
                if attempt == ATTEMPTS:
                    raise
            time.sleep(min(LONGEST_ASKED, float(asked)) if asked and asked.isdigit() else min(LONGEST_WAIT, FIRST_WAIT * 2 ** (attempt - 1)))
        raise AssertionError

    def total(self) -> int | None:
        said = self._get(1, 0)[1].rpartition("/")[2]
        return int(said) if said.isdigit() else None

    def page(self, number: int, size: int, schema: pa.Schema) -> pa.Table:
        rows, _ = self._get(size, number * size)
        return pa.Table.from_pylist([{name: row.get(name) for name in schema.names} for row in rows], schema)

    def pages(self, first: int, count: int, size: int, schema: pa.Schema) -> Iterator[pa.Table]:
        return (self.page(k, size, schema) for k in range(first, first + count))


def _server(options: dict):
    if "url" in options:
        return HttpPages(options["url"])
    if "path" in options:
        return ParquetPages(options["path"])
    raise ValueError("pages need a path or a url")


class Page(InputPartition):
    """``step`` pages from ``first`` on of a table of ``total`` rows; where these are unknown, every ``step``-th page up to a short one."""

    def __init__(self, first: int, step: int, total: int | None):
        self.first, self.step, self.total = first, step, total


class PageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.wanted = options, schema
        self.size = int(options.get("pagerows", PAGE_ROWS))
        self.number_column = options.get("pagecolumn")
        self.key = options.get("key")

    def partitions(self) -> list[InputPartition]:
        total = _server(self.options).total()
        if total is None:
            n = int(self.options.get("readers", READERS))
            return [Page(k, n, None) for k in range(n)]
        pages = max(1, -(-total // self.size))
        run = -(-pages // PARTITIONS)
        return [Page(k, min(run, pages - k), total) for k in range(0, pages, run)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        server, number, total = _server(self.options), partition.first, partition.total
        served = StructType([f for f in self.wanted if f.name != self.number_column])
        schema = to_arrow_schema(served)
        run = None if total is None else server.pages(number, partition.step, self.size, schema)
        while True:
            page = server.page(number, self.size, schema) if run is None else next(run, schema.empty_table())
            n = page.num_rows
            expected = self.size if total is None else max(0, min(self.size, total - number * self.size))
            if n > self.size or (total is not None and n != expected):
                raise ValueError(f"page {number} has {n} rows, expected {expected}: the table changed during the scan")
            if self.key:
                known = page.column(self.key).drop_null()
                if len(known.unique()) < len(known):
                    raise ValueError(f"{self.key} repeats within page {number}")
            if self.number_column:
                page = page.append_column(self.number_column, pa.array([number] * n, pa.int64())).select([f.name for f in self.wanted])
            yield from page.combine_chunks().to_batches()
            number += partition.step if total is None else 1
            if n < self.size if total is None else number == partition.first + partition.step:
                return


class PageSource(DataSource):
    """Options: path or url; pageRows; key; pageColumn, a column for the page's number; readers."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> StructType:
        if "path" not in self.options:
            raise ValueError("pages over HTTP need a schema")
        found = ParquetPages(self.options["path"]).schema()
        return found.add(self.options["pagecolumn"], "long") if self.options.get("pagecolumn") else found

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader({k.lower(): v for k, v in self.options.items()}, schema)


def refuse_repeats(rows: DataFrame, key: str) -> DataFrame:
    """The rows; reading them fails if a key that is not null repeats. Rows without a key are dealt out by their values."""
    salt = F.when(F.col(key).isNull(), F.xxhash64(*rows.columns))
    n = F.count(key).over(Window.partitionBy(key, salt))
    message = F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" repeats in the pages of one scan"))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_n")


def scan(spark: SparkSession, key: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """All pages as one table; fails if ``key`` repeats."""
    spark.dataSource.register(PageSource)
    reader = spark.read.format("pages").options(**{k: str(v) for k, v in options.items()})
    if key:
        reader = reader.option("key", key)
    rows = (reader.schema(schema) if schema else reader).load()
    return refuse_repeats(rows, key) if key else rows
