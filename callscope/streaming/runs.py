"""Running streams to a table, and reading what they report."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from callscope.session import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Custom state needs the RocksDB store; it also keeps large state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def to_table(stream: DataFrame, path: str, checkpoint: str, *, partition_by=(), available_now: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


#: The time of an end mark; no request is as late.
END = datetime(9999, 1, 1, tzinfo=timezone.utc)


def closable(logs: DataFrame, marks: str) -> DataFrame:
    """A log stream that ends when a mark is put into the folder ``marks``: all its windows then close.

    The mark is a row that moves the watermark to ``END``; windowed operators leave it out. It comes from a source of its own, so it
    can be written when the log is known to be complete, and a restarted query takes it up after the rows before it.
    """
    spark = logs.sparkSession
    spark.createDataFrame([], logs.schema).write.mode("ignore").parquet(marks)
    return logs.unionByName(read_stream(spark, marks, logs.schema))


def write_end(spark: SparkSession, marks: str, schema: T.StructType) -> None:
    """Put the end mark into ``marks``: a valid log row of nobody, at ``END``."""
    values = {"string": "end", "int": 200, "bigint": 200, "double": 0.0, "boolean": False, "timestamp": END}
    row = tuple(values.get(f.dataType.simpleString()) for f in schema)
    spark.createDataFrame([row], schema).write.mode("append").parquet(marks)


def drain(stream: DataFrame, name: str, *, close=None) -> tuple[DataFrame, StreamingQuery]:
    """Process all data present, and return the written table and the finished query.

    ``close`` is called when all data are processed (to put an end mark); what that brings is processed, too.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_dir(spark, name), scratch_dir(spark, f"{name}-checkpoint")
    query = to_table(stream, path, checkpoint)
    query.awaitTermination()
    if close:
        close()
        to_table(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), query


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped because they arrived behind the watermark."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for progress in query.recentProgress for op in progress["stateOperators"]
    )
