"""Registered queries: stream twins of the log operators, run over all data present."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.columns import time_text
from callscope.plans.admission import _log_policies
from callscope.plans.features import FEATURE_SQL, ROUNDED, _rounded_sql
from callscope.plans.models import RECENT_ANOMALIES_SQL, shown_anomalies, traffic_detector
from callscope.session import scratch_dir
from callscope.sources import adapters as A
from callscope.streaming import bucket, features, ingest, runs

QUERIES, ORACLES = {}, {}


def _log_stream(spark, sf_dir, compress: int = 600):
    """The event table as a stream of log rows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    runs.use_rocksdb(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, because a stream source may be a pattern or a folder but not a single file.
    return A.logs_from_events(runs.read_stream(spark, f"{sf_dir}/events.parque[t]", schema), compress)


def _ending_stream(spark, sf_dir):
    """The log stream, and a function that ends it."""
    logs, marks = _log_stream(spark, sf_dir), scratch_dir(spark, "stream-end")
    return runs.closable(logs, marks), lambda: runs.write_end(spark, marks, logs.schema)


def _shown(df):
    rounded = [c for c in ROUNDED if c in df.columns]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in rounded}).withColumn("window_start", time_text("window_start"))


def stream_minute_features(spark, sf_dir):
    logs, end = _ending_stream(spark, sf_dir)
    rows = features.stream_minute_features(logs).withColumn("window_start", F.col("window.start")).drop("window")
    out, _ = runs.drain(rows, "stream-features", close=end)
    return _shown(out)


QUERIES["stream_minute_features"] = stream_minute_features
_BASIC = [c for c in ROUNDED if c != "request_rate_change"]
ORACLES["stream_minute_features"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    f"""SELECT * EXCLUDE (request_rate_change) REPLACE ({_rounded_sql(_BASIC)}, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start)
FROM features""",
)


def stream_rate_change(spark, sf_dir):
    logs, end = _ending_stream(spark, sf_dir)
    out, _ = runs.drain(features.stream_rate_change(features.stream_minute_features(logs)), "stream-change", close=end)
    return _shown(out).select("tenant_id", "client_id", "route_id", "window_start", "request_count", "request_rate_change")


QUERIES["stream_rate_change"] = stream_rate_change
ORACLES["stream_rate_change"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    """SELECT tenant_id, client_id, route_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, request_count,
  round(request_rate_change, 6) AS request_rate_change FROM features""",
)


def _limits(spark, sf_dir):
    return _log_policies(spark, sf_dir).select(
        "tenant_id",
        "client_id",
        "route_id",
        F.col("policy.bucket_capacity").alias("bucket_capacity"),
        F.col("policy.refill_rate").alias("refill_rate"),
    )


def stream_token_bucket(spark, sf_dir):
    limits = _limits(spark, sf_dir)
    requests = _log_stream(spark, sf_dir).join(limits, ["tenant_id", "client_id", "route_id"])
    out, _ = runs.drain(bucket.stream_token_buckets(requests), "stream-buckets")
    return out.select("id", "tenant_id", "client_id", "route_id", "allowed", F.round("remaining", 9).alias("remaining"), "retry_after_ns")


QUERIES["stream_token_bucket"] = stream_token_bucket


def _replay_sql():
    from callscope.plans.admission import REPLAY_SQL

    return REPLAY_SQL


ORACLES["stream_token_bucket"] = _replay_sql()


def stream_deduplicated(spark, sf_dir):
    """The log, delivered twice, stored once."""
    logs = _log_stream(spark, sf_dir)
    twice = logs.unionByName(_log_stream(spark, sf_dir))
    out, _ = runs.drain(ingest.clean_ids(ingest.deduplicate(twice)), "stream-dedup")
    return out.groupBy("tenant_id", "client_id").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("request_id").alias("request_count"))


QUERIES["stream_deduplicated"] = stream_deduplicated
ORACLES["stream_deduplicated"] = A.with_ctes(
    A.sql_logs(), "SELECT tenant_id, client_id, count(*) AS row_count, count(DISTINCT request_id) AS request_count FROM request_logs GROUP BY 1, 2"
)


def stream_last_used(spark, sf_dir):
    path = scratch_dir(spark, "clients")
    query = ingest.last_used_versions(
        _log_stream(spark, sf_dir), A.api_clients(spark, sf_dir), path, scratch_dir(spark, "clients-checkpoint")
    )
    query.awaitTermination()
    last = max(p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0)
    return ingest.read_version(spark, path, last).select("tenant_id", "id", time_text("last_used_at").alias("last_used_at"))


QUERIES["stream_last_used"] = stream_last_used
ORACLES["stream_last_used"] = A.with_ctes(
    A.sql_logs(),
    A.SQL_CLIENTS,
    """SELECT c.tenant_id, c.id, strftime(max(l.created_at), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM api_clients c
LEFT JOIN request_logs l ON l.client_id = c.id AND l.tenant_id = c.tenant_id GROUP BY 1, 2""",
)


def stream_anomalies(spark, sf_dir):
    """Windows of the stream scored as they close, by a forest trained on normal windows."""
    detector = traffic_detector(spark, sf_dir)
    logs, end = _ending_stream(spark, sf_dir)
    rows = features.stream_rate_change(features.stream_minute_features(logs))
    path, checkpoint = scratch_dir(spark, "stream-anomalies"), scratch_dir(spark, "stream-anomalies-checkpoint")
    for close in (end, None):
        ingest.score_stream(rows, detector, path, checkpoint).awaitTermination()
        if close:
            close()
    return shown_anomalies(spark.read.parquet(path).drop("batch"))


QUERIES["stream_anomalies"] = stream_anomalies
ORACLES["stream_anomalies"] = RECENT_ANOMALIES_SQL


def stream_bucket_slices(spark, sf_dir):
    """The log in three micro-batches, each replayed in time chunks from the bucket states that the one before left."""
    parts, path = scratch_dir(spark, "deliveries"), scratch_dir(spark, "bucket-states")
    logs = A.request_logs(spark, sf_dir).join(_limits(spark, sf_dir), ["tenant_id", "client_id", "route_id"])
    part = F.least(F.floor((F.unix_micros("created_at") - A.BASE_MICROS) / (24 * 60 * 10**6)), F.lit(2))
    runs.use_rocksdb(spark)
    checkpoint = scratch_dir(spark, "bucket-checkpoint")
    for number in range(3):
        # Written by many tasks; a run takes all files of a delivery as one micro-batch.
        logs.where(part == number).write.mode("append").parquet(parts)
        bucket.replay_stream(runs.read_stream(spark, parts, logs.schema), path, checkpoint).awaitTermination()
    out = spark.read.parquet(f"{path}/decisions")
    return out.select("id", "tenant_id", "client_id", "route_id", "allowed", F.round("remaining", 9).alias("remaining"), "retry_after_ns")


QUERIES["stream_bucket_slices"] = stream_bucket_slices
ORACLES["stream_bucket_slices"] = _replay_sql()


def stream_late_rows(spark, sf_dir):
    """The log delivered in three parts out of order: what is in time, and what comes behind the watermark."""
    parts, path = scratch_dir(spark, "deliveries"), scratch_dir(spark, "late-rows")
    logs = A.request_logs(spark, sf_dir)
    for part in range(3):
        logs.where(F.col("id").cast("bigint") % 3 == part).coalesce(1).write.mode("append").parquet(parts)
    stream = runs.read_stream(spark, parts, logs.schema, files_per_trigger=1)
    ingest.split_late(stream, path, scratch_dir(spark, "late-rows-checkpoint")).awaitTermination()
    rows = [spark.read.parquet(f"{path}/{kind}").select(F.lit(kind).alias("kind"), "tenant_id", "id") for kind in ("on_time", "late")]
    return rows[0].unionByName(rows[1])


QUERIES["stream_late_rows"] = stream_late_rows
ORACLES["stream_late_rows"] = A.with_ctes(
    A.sql_logs(),
    """parts AS (SELECT *, CAST(id AS BIGINT) % 3 AS part FROM request_logs),
newest AS (SELECT part, max(created_at) AS newest FROM parts GROUP BY 1)
SELECT CASE WHEN created_at < (SELECT max(newest) FROM newest n WHERE n.part < p.part) - INTERVAL 10 MINUTE THEN 'late' ELSE 'on_time' END AS kind, tenant_id, id FROM parts p""",
)
