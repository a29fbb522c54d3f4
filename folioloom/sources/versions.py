"""Tables that are published together, as versions of one folder.

    folder/data/<id>/<table>     the tables of a publication, plain Parquet
    folder/data/<id>/state.json  version number, and rows and digest of each table
    folder/CURRENT               the id that readers follow

All tables of a publication are written aside first. Then CURRENT is renamed over, in one step of the file
system: a reader sees the pair before or the pair after, and a failure at any point leaves the pair before. A publication
whose tables are what is current already is dropped again, so a repeated run changes nothing. The last ``keep``
versions stay, for readers that began with one. One writer at a time is assumed, as in a nightly build; a second one that
began from another version is refused.

It is no table format: there is no log, no update of rows, and Spark's own commit protocol writes the files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows, and a digest that no order of rows changes: sums of two hashes of each row, with the schema."""
    columns = [F.to_json(F.struct(F.col(f"`{name}`").alias("v"))) if "map<" in kind or "variant" in kind else F.col(f"`{name}`") for name, kind in rows.dtypes]
    whole = [F.lit("row"), *columns]  # a table without columns has rows as well
    found = rows.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(*whole).cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64(F.lit("again"), *whole).cast("decimal(38,0)")).alias("b"),
    ).first()
    kinds = ",".join(f"{name}:{kind}" for name, kind in rows.dtypes)
    return found["n"], f"{kinds}|{found['n']}|{found['a']}|{found['b']}"


class Versions:
    """The versions below ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._java = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._java.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self._conf)

    def _text(self, *parts: str) -> str | None:
        if not self._files().exists(self._path(*parts)):
            return None
        stream = self._files().open(self._path(*parts))
        try:
            return bytes(self._java.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, text: str, *parts: str) -> None:
        stream = self._files().create(self._path(*parts), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def state(self) -> dict | None:
        """id, version number and tables of the current version; None before the first."""
        name = self._text("CURRENT")
        return json.loads(self._text("data", name, "state.json")) if name else None

    def read(self, table: str, state: dict | None = None) -> DataFrame:
        """A table of the version that ``state`` names, else of the current one."""
        state = state or self.state()
        if not state or table not in state["tables"]:
            raise LookupError(f"no version of {table} in {self.folder}")
        return self.spark.read.schema(state["tables"][table]["schema"]).parquet(f"{self.folder}/data/{state['id']}/{table}")

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None) -> tuple[int, str]:
        """(version, "created", "changed" or "unchanged"). With ``expected``, another current version is an error.

        Tables may be computed from the current version's: nothing is overwritten.
        """
        before = self.state()
        if expected is not None and expected != (before["version"] if before else 0):
            raise RuntimeError(f"version {before['version'] if before else 0} is current, not {expected}")
        new = uuid.uuid4().hex
        try:
            found = {}
            for name, rows in tables.items():
                place = f"{self.folder}/data/{new}/{name}"
                rows.write.parquet(place)
                n, sum_ = digest(self.spark.read.schema(rows.schema).parquet(place))
                found[name] = {"rows": n, "digest": sum_, "schema": rows.schema.toDDL()}
            if before and {k: v["digest"] for k, v in found.items()} == {k: v["digest"] for k, v in before["tables"].items()}:
                self._files().delete(self._path("data", new), True)
                return before["version"], "unchanged"
            version = before["version"] + 1 if before else 1
            self._write(json.dumps({"id": new, "version": version, "before": before and before["id"], "tables": found}), "data", new, "state.json")
            if (now := self._text("CURRENT")) != (before["id"] if before else None):
                raise RuntimeError(f"another writer has published {now}")
            self._swap(new)
        except BaseException:
            if self._text("CURRENT") != new:
                self._files().delete(self._path("data", new), True)
            raise
        self._drop_old()
        return version, "changed" if before else "created"

    def _swap(self, name: str) -> None:
        """Rename CURRENT over in one step."""
        aside = f"CURRENT-{name}"
        self._write(name, aside)
        context = self._java.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._java.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._java.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(self._path(aside)), context.makeQualified(self._path("CURRENT")), options)

    def history(self) -> list[dict]:
        """States of the versions that are left, the current one first."""
        out, name = [], self._text("CURRENT")
        while name and (text := self._text("data", name, "state.json")):
            out.append(json.loads(text))
            name = out[-1]["before"]
        return out

    def _drop_old(self) -> None:
        kept = {state["id"] for state in self.history()[: self.keep]}
        for status in self._files().listStatus(self._path("data")):
            if status.getPath().getName() not in kept:
                self._files().delete(status.getPath(), True)
