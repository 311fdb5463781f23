"""Tables kept in versions: a merge rewrites the buckets it touches and commits once.

Rows lie in Parquet folders by bucket (a hash of the ``by`` columns). A version is a small
JSON file that names, for each bucket, the folder that holds it; folders are never changed. A merge
reads the buckets of the incoming rows, writes their new state to a new folder, and commits
a version that points to it and to the old folders of all other buckets. The commit is a rename
that fails if the version exists, so of two merges from one version the second is refused and nothing is
lost; old versions stay readable. Written files are whole before the commit, so a lost
executor, or a job that stops half way, leaves the last version as it was.

The file system must refuse to rename over a file (HDFS does; for object stores use one that has
conditional writes). The driver sees bucket numbers and folder names only, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another writer has committed the version this merge was meant to become."""


@dataclass(frozen=True)
class Commit:
    """A committed version, and how many buckets it wrote anew and took over unread."""

    version: int
    touched: int
    kept: int


def bucket_of(columns, buckets: int) -> Column:
    """A bucket number from the values of some columns; null and '' are one value. SQL engines can compute it too."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


class VersionedTable:
    """A table in versions under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._folder = hadoop.fs.Path(f"{self.path}/versions")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, rows: DataFrame, path: str, by, buckets: int = BUCKETS) -> VersionedTable:
        """Version 0 from ``rows``."""
        table = cls(rows.sparkSession, path)
        empty = {"by": list(by), "buckets": buckets, "schema": rows.schema.json(), "folders": {}}
        folders = table._write(rows, empty)
        table._commit(0, empty | {"folders": folders})
        return table

    def versions(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        found = self.versions()
        if not found:
            raise ValueError(f"no version of a table under {self.path}")
        return found[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (default: the latest)."""
        return self._read(self._state(self.latest() if version is None else version))

    def files(self, version: int | None = None) -> dict[int, str]:
        """The folder of every bucket that has rows."""
        state = self._state(self.latest() if version is None else version)
        return {int(b): f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in state["folders"].items()}

    def merge(
        self, incoming: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], *, base: int | None = None
    ) -> Commit:
        """Commit what ``rule(stored, incoming)`` makes of the buckets that ``incoming`` touches.

        ``stored`` holds these buckets only, so the rule may depend on rows with equal ``by`` columns, no others.
        ``incoming`` is read twice. ``base`` is the version to start from; if it has a successor, ConflictError.
        """
        base = self.latest() if base is None else base
        state = self._state(base)
        numbers = incoming.select(bucket_of(state["by"], state["buckets"]).alias("b")).distinct().collect()
        return self._replace(base, state, {r["b"] for r in numbers}, lambda stored: rule(stored, incoming))

    def rewrite(self, rule: Callable[[DataFrame], DataFrame], *, base: int | None = None) -> Commit:
        """Commit ``rule(stored)`` for the whole table."""
        base = self.latest() if base is None else base
        state = self._state(base)
        return self._replace(base, state, set(range(state["buckets"])), rule)

    def _replace(self, base: int, state: dict, touched: set[int], rule) -> Commit:
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched}
        kept = len(folders)
        if touched:
            folders |= self._write(rule(self._read(state, touched)), state)
        self._commit(base + 1, state | {"folders": folders})
        return Commit(base + 1, len(touched), kept)

    def _read(self, state: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.path}/{f}/{BUCKET}={b}" for b, f in state["folders"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, rows: DataFrame, state: dict) -> dict[str, str]:
        """Rows in a new folder, by bucket; a bucket with most rows is written by several tasks."""
        names = [f["name"] for f in json.loads(state["schema"])["fields"]]
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*names).withColumn(BUCKET, bucket_of(state["by"], state["buckets"]))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        listed = self._files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"))
        found = [s.getPath().getName() for s in listed]
        return {n.split("=")[1]: folder for n in found if n.startswith(f"{BUCKET}=")}

    def _state(self, version: int) -> dict:
        row = self.spark.read.text(f"{self.path}/versions/{version:020d}.json", wholetext=True).first()
        return json.loads(row[0])

    def _commit(self, version: int, state: dict) -> None:
        fs = self.spark._jvm.org.apache.hadoop.fs
        draft, final = (fs.Path(self._folder, n) for n in (f"_{uuid.uuid4().hex}", f"{version:020d}.json"))
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise ConflictError(f"version {version} of {self.path} exists already") from error
            raise
