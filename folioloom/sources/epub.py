"""EPUB files as tables: entries of the archives, packages and their reading order, chapters.

Only the opening of an archive is Python, a row an entry; the container, the package and the pages are read by column
expressions, and pages meet their place in the reading order in a join. A file that is no archive, or has no package, gives one row
with ``error``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions import text

from .shared import ship

CONTAINER = "META-INF/container.xml"
#: Characters that a block and a chapter have at least.
BLOCK_CHARACTERS, CHAPTER_CHARACTERS = 6, 50
#: Entries that are read: markup, by their names.
MARKUP = (".xml", ".opf", ".xhtml", ".html", ".htm")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "name", "content", "error"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows = [(path, e.filename, archive.read(e).decode("utf-8", "replace"), None) for e in archive.infolist() if e.filename.lower().endswith(MARKUP)]
            except Exception as error:  # a file from outside may be broken in any way
                rows = [(path, None, None, f"{type(error).__name__}: {error}")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=names)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, error) of the markup within every EPUB file below ``path``."""
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(path)
    return found.select("path", "content").mapInArrow(_opened, "path string, name string, content string, error string")


def attribute(element: Column, name: str) -> Column:
    """The value of an attribute of a start tag, '' without it."""
    found = F.regexp_extract(element, f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'[^']*')", 1)
    single = F.regexp_extract(element, f"(?is)\\s{name}\\s*=\\s*'([^']*)'", 1)
    return text.html_text(F.when(found != "", found).otherwise(single))


def start_tags(markup: Column, name: str) -> Column:
    return F.regexp_extract_all(markup, F.lit(f"(?is)<(?:[\\w-]+:)?{name}\\b[^>]*>"), F.lit(0))


def packages(found: DataFrame) -> DataFrame:
    """(path, title, author, folder, spine) of the archives' packages; spine: names of entries in reading order."""
    root = attribute(F.get(start_tags(F.col("content"), "rootfile"), F.lit(0)), "full-path")
    roots = found.where(F.col("name") == CONTAINER).select("path", root.alias("name"))
    both = roots.join(found.select("path", "name", "content"), ["path", "name"])
    told = lambda name: text.html_text(F.regexp_extract("content", f"(?is)<(?:[\\w-]+:)?{name}\\b[^>]*>(.*?)</(?:[\\w-]+:)?{name}\\s*>", 1))
    folder = F.regexp_extract("name", "^(.*/)?[^/]*$", 1)
    items = F.map_from_entries(F.array_distinct(F.transform(start_tags(F.col("content"), "item"), lambda t: F.struct(attribute(t, "id"), attribute(t, "href")))))
    listed = both.select("path", told("title").alias("title"), told("creator").alias("author"), folder.alias("folder"), items.alias("_items"), F.transform(start_tags(F.col("content"), "itemref"), lambda t: attribute(t, "idref")).alias("_refs"))
    places = F.filter(F.transform("_refs", lambda r: F.try_element_at("_items", r)), lambda h: h.isNotNull())
    spine = F.transform(places, lambda h: F.concat("folder", F.try_url_decode(F.replace(F.regexp_replace(h, "#.*$", ""), F.lit("+"), F.lit("%2B")))))
    return listed.select("path", "title", "author", "folder", spine.alias("spine"))


def page_title(markup: Column) -> Column:
    """The first title or heading of the first two levels that says something."""
    marks = F.regexp_extract_all(markup, F.lit("(?is)<(?:title|h1|h2)\\b[^>]*>.*?</(?:title|h1|h2)\\s*>"), F.lit(0))
    return F.coalesce(F.get(F.filter(F.transform(marks, text.html_text), lambda t: t != ""), F.lit(0)), F.lit(""))


def page_text(markup: Column) -> Column:
    """Blocks of a page's body of some length, joined by blank lines."""
    body = F.regexp_replace(markup, "(?is)<(script|style|head)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    cut = F.regexp_replace(body, "(?i)</?(?:p|div|section|h[1-6]|li|blockquote)\\b[^>]*>", "\u0001")
    blocks = F.filter(F.transform(F.split(cut, "\u0001"), text.html_text), lambda b: F.length(b) >= BLOCK_CHARACTERS)
    return F.array_join(blocks, "\n\n")


def chapters(spark: SparkSession, path: str, least: int = CHAPTER_CHARACTERS) -> DataFrame:
    """(path, title, author, number, chapter_title, text, error): chapters of every EPUB file below ``path`` with ``least`` characters, in reading order."""
    found = entries(spark, path)
    books = packages(found)
    placed = books.select("path", "title", "author", F.posexplode("spine").alias("_at", "name"))
    pages = placed.join(found.select("path", "name", "content"), ["path", "name"]).select("path", "title", "author", "_at", page_title(F.col("content")).alias("chapter_title"), page_text(F.col("content")).alias("text"))
    kept = pages.where(F.length("text") >= least)
    number = F.row_number().over(Window.partitionBy("path").orderBy("_at"))  # within a book
    numbered = kept.withColumn("number", number)
    title = F.coalesce(F.nullif("chapter_title", F.lit("")), F.concat(F.lit("Chapter "), F.col("number").cast("string")))
    good = numbered.select("path", "title", "author", "number", title.alias("chapter_title"), "text", F.lit(None).cast("string").alias("error"))
    files = found.groupBy("path").agg(F.max("error").alias("error"))
    bad = files.join(books.where(F.size("spine") > 0).select("path"), "path", "left_anti").select("path", F.coalesce("error", F.lit("no package with a reading order")).alias("error"))
    none = {name: F.lit(None).cast(kind) for name, kind in good.dtypes if name not in ("path", "error")}
    return good.unionByName(bad.withColumns(none))
