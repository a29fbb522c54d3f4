"""Files named by a key, written by a Spark job and published all at once: the data source ``keyed_files``.

Rows have a column ``path``, the file's place below the folder (``<slug>/<number>``), and ``content``. Tasks write below
``data/<job>``, each file under its own name in one step, so a repeated task writes the same files again. The commit
renames CURRENT over; until then, and after a failure, readers have the files of the job before. CURRENT also holds
how many files and bytes the job wrote. The job before the last is dropped with the next commit.

The folder is one that driver and executors share.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files, paged


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if re.match(r"^\w+:", folder) else (pyarrow.fs.LocalFileSystem(), folder)


def _put(system: pyarrow.fs.FileSystem, place: str, content: bytes) -> None:
    system.create_dir(place.rpartition("/")[0], recursive=True)
    aside = f"{place}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(aside) as out:
        out.write(content)
    system.move(aside, place)


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class KeyedWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        system, root = _place(self.folder)
        n = size = 0
        for row in iterator:
            if not row["path"] or not re.fullmatch(r"[^/]+(/[^/]+)*", row["path"]) or any(p in (".", "..") for p in row["path"].split("/")):
                raise ValueError(f"{row['path']!r} is no place below a folder")
            content = row["content"]
            content = (content or "").encode() if content is None or isinstance(content, str) else bytes(content)
            _put(system, f"{root}/data/{self.job}/{row['path']}", content)
            n, size = n + 1, size + len(content)
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.folder)
        system.create_dir(f"{root}/data/{self.job}", recursive=True)
        before = current(self.folder)
        done = [m for m in messages if m]
        state = {"id": self.job, "before": before and before["id"], "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        _put(system, f"{root}/CURRENT", json.dumps(state).encode())
        for found in system.get_file_info(pyarrow.fs.FileSelector(f"{root}/data")):
            if found.base_name not in (self.job, state["before"]):
                system.delete_dir(found.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _place(self.folder)
        if system.get_file_info(f"{root}/data/{self.job}").type == pyarrow.fs.FileType.Directory:
            system.delete_dir(f"{root}/data/{self.job}")


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("keyed files need the columns path and content")
        return KeyedWriter(self.options["path"])


def current(folder: str) -> dict | None:
    """id, files and bytes of the published job; None before the first."""
    system, root = _place(folder)
    if system.get_file_info(f"{root}/CURRENT").type != pyarrow.fs.FileType.File:
        return None
    with system.open_input_stream(f"{root}/CURRENT") as stream:
        return json.loads(stream.read())


def publish(rows: DataFrame, folder: str) -> dict:
    """Writes rows (path, content) as files below ``folder``, all or none; fails if a path repeats. Returns the published state."""
    rows.sparkSession.dataSource.register(KeyedFiles)
    paged.refuse_repeats(rows.select("path", "content"), "path").write.format("keyed_files").mode("append").option("path", folder).save()
    return current(folder)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the published files, by their keys."""
    state = current(folder)
    if not state:
        raise LookupError(f"nothing is published in {folder}")
    if not state["files"]:
        return spark.createDataFrame([], "path string, bytes long")
    found = files.listing(spark, f"{folder.rstrip('/')}/data/{state['id']}")
    return found.select(F.regexp_extract("path", f"/data/{state['id']}/(.*)$", 1).alias("path"), "bytes")
