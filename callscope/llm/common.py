"""Helpers shared by the operators: row keys, shared folders, Arrow batches as byte arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.session import scratch_dir

#: Rows of an Arrow batch, and bytes of text that are worked on at once inside a task.
BATCH_ROWS = 1000
SLICE_BYTES = 2 << 20


def ready(spark: SparkSession) -> None:
    """Batches small enough for tables whose rows are whole documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, and safe if executors are lost."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, the text (null: empty) and a hash of it.

    Id and hash together name a row wherever rows are joined, so rows that share an id stay
    apart as long as their texts differ; rows equal in both count as one document and get
    the same answer. Other columns are left out, so their names cannot clash.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_hash"))


def same_row(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and where each row begins (one more at the end)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows_bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def with_column(
    docs: DataFrame, name: str, kind: T.DataType, measure: Callable[[pa.Array], pa.Array], text: str = "text"
) -> DataFrame:
    """All columns of ``docs`` and ``name``, which ``measure`` derives from slices of the text column."""
    ready(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for batch in slices(batches, text):
            made = measure(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def new_name(docs: DataFrame, wish: str) -> str:
    """A column name that ``docs`` does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Bytes of ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
