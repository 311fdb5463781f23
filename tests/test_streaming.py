"""Streams fed in several micro-batches must give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from callscope.operators import features
from callscope.operators.bucket import replay
from callscope.schemas import REQUEST_LOGS
from callscope.sources import adapters as A
from callscope.streaming import bucket, ingest, runs
from callscope.streaming import features as streaming


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The log as six files in order of time, one per micro-batch."""
    path = str(tmp_path_factory.mktemp("log") / "parts")
    order = A.request_logs(spark, sf_dir).selectExpr("*", "ntile(6) over (order by created_at, id) as part")
    for i in range(1, 7):
        order.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    runs.use_rocksdb(spark)
    return runs.read_stream(spark, path, REQUEST_LOGS, files_per_trigger=1)


def test_rate_change_over_batches(spark, sf_dir, parts):
    out, query = runs.drain(streaming.stream_rate_change(streaming.stream_minute_features(stream(spark, parts))), "t")
    got = {(r["client_id"], r["route_id"], r["window_start"]): (r["request_count"], r["request_rate_change"], r["401_rate"]) for r in out.collect()}
    batch = features.minute_features(A.request_logs(spark, sf_dir))
    want = {(r["client_id"], r["route_id"], r["window_start"]): (r["request_count"], r["request_rate_change"], r["401_rate"]) for r in batch.collect()}
    assert len(got) > 0.9 * len(want)
    assert all(want[k] == v for k, v in got.items())
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) == 6
    assert runs.late_rows(query) == 0


@pytest.mark.parametrize("variant", ["local", "shared"])
def test_buckets_over_batches(spark, sf_dir, parts, variant):
    limits = {"bucket_capacity": F.lit(2.0), "refill_rate": F.lit(0.01)}
    out, _ = runs.drain(bucket.stream_token_buckets(stream(spark, parts).withColumns(limits), variant=variant), "t")
    got = {r["id"]: (r["allowed"], r["remaining"], r["retry_after_ns"]) for r in out.collect()}
    want = replay(A.request_logs(spark, sf_dir).withColumns(limits), variant=variant, chunk_seconds=300)
    assert got == {r["id"]: (r["allowed"], r["remaining"], r["retry_after_ns"]) for r in want.collect()}
    assert {a for a, _, _ in got.values()} == {True, False}


def test_late_requests_are_decided_without_gain(spark, tmp_path):
    rows = [("1", 100), ("2", 200), ("3", 150)]
    path = str(tmp_path / "r")
    for i, at in rows:
        spark.createDataFrame([(i, "t", "c", "r", at)], "id string, tenant_id string, client_id string, route_id string, at bigint").select(
            "id", "tenant_id", "client_id", "route_id", F.timestamp_seconds("at").alias("created_at"), F.lit(5.0).alias("bucket_capacity"), F.lit(0.0).alias("refill_rate")
        ).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    out, _ = runs.drain(bucket.stream_token_buckets(runs.read_stream(spark, path, schema, files_per_trigger=1)), "t")
    assert {r["id"]: r["status"] for r in out.collect()} == {"1": "allowed", "2": "allowed", "3": "allowed"}
    assert {r["id"]: r["remaining"] for r in out.collect()} == {"1": 4.0, "2": 3.0, "3": 2.0}


def test_late_rows_are_reported(spark, sf_dir, parts, tmp_path):
    path = str(tmp_path / "late")
    rows = spark.read.parquet(parts)
    newest = rows.orderBy(F.col("created_at").desc()).limit(50)
    for part in (newest, newest.withColumn("created_at", F.col("created_at") + F.expr("interval 5 minutes")), rows.orderBy("created_at").limit(10)):
        part.coalesce(1).write.mode("append").parquet(path)
    _, query = runs.drain(streaming.stream_rate_change(streaming.stream_minute_features(stream(spark, path))), "t")
    assert runs.late_rows(query) > 0


def test_end_mark_closes_all_windows(spark, sf_dir, parts, tmp_path):
    marks = str(tmp_path / "marks")
    logs = runs.closable(stream(spark, parts), marks)
    out, _ = runs.drain(streaming.stream_minute_features(logs), "t", close=lambda: runs.write_end(spark, marks, logs.schema))
    want = features.minute_features(A.request_logs(spark, sf_dir))
    assert out.count() == want.count() and out.where("tenant_id = 'end'").count() == 0


@pytest.mark.parametrize("variant", ["local", "shared"])
def test_sliced_replay_of_a_stream_equals_the_batch(spark, sf_dir, parts, variant, tmp_path):
    limits = {"bucket_capacity": F.lit(2.0), "refill_rate": F.lit(0.01)}
    bucket.replay_stream(stream(spark, parts).withColumns(limits), str(tmp_path / "b"), str(tmp_path / "c"), variant=variant, buckets=4).awaitTermination()
    got = {r["id"]: (r["allowed"], r["remaining"], r["retry_after_ns"]) for r in spark.read.parquet(str(tmp_path / "b/decisions")).collect()}
    want = replay(A.request_logs(spark, sf_dir).withColumns(limits), variant=variant, chunk_seconds=300)
    assert got == {r["id"]: (r["allowed"], r["remaining"], r["retry_after_ns"]) for r in want.collect()}


def test_late_rows_are_kept_apart(spark, parts, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.read.parquet(parts)
    old = rows.orderBy("created_at").limit(10)
    for part in (rows.orderBy(F.col("created_at").desc()).limit(50), old.union(rows.limit(1).withColumn("created_at", F.lit(None).cast("timestamp")))):
        part.coalesce(1).write.mode("append").parquet(path)
    ingest.split_late(stream(spark, path), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    on_time, late = (spark.read.parquet(f"{tmp_path}/out/{kind}") for kind in ("on_time", "late"))
    assert on_time.count() == 51 and late.count() == 10 and on_time.where("created_at is null").count() == 1
