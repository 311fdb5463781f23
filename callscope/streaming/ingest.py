"""Log ingest, last-used upkeep and scoring inside micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.functions.columns import blank_to_null
from callscope.operators.detect import Detector, anomalies, score
from callscope.operators.upsert import touch_clients


def deduplicate(logs: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Each ``request_id`` once; state is dropped once the watermark has passed it."""
    return logs.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["request_id"])


def clean_ids(logs: DataFrame) -> DataFrame:
    return logs.withColumns({c: blank_to_null(c) for c in ("client_id", "route_id")})


def for_each(stream: DataFrame, work, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def last_used_versions(logs: DataFrame, clients: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep ``last_used_at`` current: each micro-batch writes a new version of the table.

    A repeated batch writes the same version again from the one before it, so a restart
    changes nothing.
    """

    def work(batch: DataFrame, number: int) -> None:
        before = clients if number == 0 else read_version(batch.sparkSession, path, number - 1)
        touch_clients(before, batch).write.mode("overwrite").parquet(f"{path}/version={number}")

    return for_each(logs, work, checkpoint)


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={number}")


def score_stream(features: DataFrame, detector: Detector, path: str, checkpoint: str) -> StreamingQuery:
    """Append the anomalous windows of a feature stream (with rate change) to a table."""

    def work(batch: DataFrame, number: int) -> None:
        anomalies(score(detector, batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return for_each(features, work, checkpoint)


def split_late(logs: DataFrame, path: str, checkpoint: str, *, delay: str = "10 minutes") -> StreamingQuery:
    """Rows in time to ``path``/on_time, rows behind the watermark to ``path``/late; none is lost.

    The watermark of a micro-batch is the newest time of all batches before it, less the delay, as in
    Structured Streaming. It is kept next to the rows, by batch, so a repeated batch is split the same way.
    Rows without a time are on time.
    """
    spark = logs.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        seen = spark.read.parquet(f"{path}/newest/batch={number - 1}") if number else spark.createDataFrame([], "newest timestamp")
        mark = seen.agg((F.max("newest") - F.expr(f"interval {delay}")).alias("mark")).first()["mark"]
        behind = F.coalesce(F.col("created_at") < F.lit(mark).cast("timestamp"), F.lit(False))
        batch.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.where(~behind).write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
        newest = batch.agg(F.max("created_at").alias("newest")).unionByName(seen).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch={number}")

    return for_each(logs, work, checkpoint)
