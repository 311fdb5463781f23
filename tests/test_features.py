from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from callscope.operators import features, scan, series, traffic
from callscope.schemas import require_columns

LOG = "tenant_id string, client_id string, route_id string, method string, status_code string, latency_ms string, blocked string, created_at string"


def row(tenant="tenant-a", at="2026-09-26T10:00:05Z", method="GET", status="200", latency="10", blocked="false"):
    return (tenant, "client-a", "route-a", method, status, latency, blocked, at)


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def test_minute_features_of_three_rows(spark):
    out = features.with_iso_window(
        features.minute_features(
            logs(
                spark,
                row(),
                row(at="2026-09-26T10:00:20Z", method="post", status="429", latency="30", blocked="true"),
                row(at="2026-09-26T10:01:05Z", status="500", latency="50"),
            )
        )
    ).orderBy("window_start").collect()
    first, second = out
    assert first["window_start"] == "2026-09-26T10:00:00Z"
    assert (first["request_count"], first["success_count"], first["error_count"]) == (2, 1, 1)
    assert first["count_429"] == first["blocked_count"] == 1
    assert first["429_rate"] == first["error_rate"] == 0.5
    assert (first["average_latency_ms"], first["p50_latency_ms"], first["max_latency_ms"]) == (20, 20, 30)
    assert first["p95_latency_ms"] == pytest.approx(29)
    assert first["unique_methods"] == 2 and first["request_rate_change"] == 0
    assert (second["count_5xx"], second["5xx_rate"], second["request_rate_change"]) == (1, 1, -0.5)


def test_one_tenant_equals_filtered_all(spark):
    rows = logs(spark, row(), row(tenant="tenant-b", status="500", latency="90000"))
    one = features.minute_features(rows, "tenant-a").collect()
    both = features.minute_features(rows).where("tenant_id = 'tenant-a'").collect()
    assert one == both and len(one) == 1
    assert one[0]["5xx_rate"] == 0 and one[0]["average_latency_ms"] == 10


@pytest.mark.parametrize(
    "bad,reason",
    [
        (dict(at="not-a-time"), "created_at"),
        (dict(status="999"), "status_code"),
        (dict(latency="-5"), "latency_ms"),
        (dict(method=" "), "method"),
        (dict(blocked="not-a-boolean"), "blocked"),
    ],
)
def test_invalid_rows_are_dropped_with_a_reason(spark, bad, reason):
    rows = logs(spark, row(**bad))
    assert features.minute_features(rows).count() == 0
    assert [r["reason"] for r in features.rejected_logs(rows).collect()] == [reason]


def test_text_flags(spark):
    rows = logs(spark, row(blocked=" F "), row(blocked="T"), row(blocked="1"), row(blocked="0"))
    out = features.minute_features(rows).first()
    assert (out["request_count"], out["blocked_count"], out["success_count"]) == (4, 2, 2)


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="blocked"):
        features.minute_features(logs(spark, row()).drop("blocked"))
    require_columns(logs(spark, row()), ["method"])


def test_bounded_scan_arguments(spark):
    typed = logs(spark, row(), row(at="2026-09-26T10:00:06Z")).select(
        "*", F.col("created_at").cast("timestamp").alias("at"), F.monotonically_increasing_id().cast("string").alias("id")
    ).drop("created_at").withColumnRenamed("at", "created_at")
    start = datetime(2026, 9, 26, tzinfo=timezone.utc)
    end = start + timedelta(days=1)
    assert scan.bounded_scan(typed, " tenant-a ", start, end).count() == 2
    assert scan.bounded_scan(typed, "tenant-a", start, end, limit=1).count() == 1
    assert scan.bounded_scan(typed, "tenant-a", start, end, client_id="  ").count() == 2
    assert scan.bounded_scan(typed, "tenant-a", start, end, client_id="other").count() == 0
    for args in (
        (" ", start, end),
        ("tenant-a", start.replace(tzinfo=None), end),
        ("tenant-a", end, start),
        ("tenant-a", start, start + timedelta(days=91)),
    ):
        with pytest.raises(ValueError):
            scan.bounded_scan(typed, *args)
    with pytest.raises(ValueError):
        scan.bounded_scan(typed, "tenant-a", start, end, limit=0)


def test_dashboard_summary_and_sentence(spark):
    rows = logs(spark, row(status="429", latency="23", blocked="true"), row(latency="17"))
    typed = rows.select(
        "tenant_id", F.lit("client-real").alias("client_id"), F.lit("route-real").alias("route_id"), "method",
        F.col("status_code").cast("int"), F.col("latency_ms").cast("bigint"), F.col("blocked").cast("boolean"),
        F.col("created_at").cast("timestamp"), F.monotonically_increasing_id().cast("string").alias("id"),
    )
    out = traffic.dashboard_summary(typed).first()
    assert (out["requests"], out["blocked_requests"], out["error_requests"]) == (2, 1, 1)
    assert out["most_used_route"] == "route-real" and out["average_latency_ms"] == 20.0
    assert out["status_counts"] == {"200": 1, "429": 1}
    tenants = spark.createDataFrame([("tenant-a",), ("tenant-z",)], "id string")
    shown = {r["tenant_id"]: r for r in traffic.overview(tenants, typed).collect()}
    assert shown["tenant-a"]["summary"].startswith("2 requests observed")
    assert shown["tenant-a"]["anomaly_count"] is None and shown["tenant-a"]["model_status"] == "unavailable"
    assert shown["tenant-z"]["summary"].startswith("No request logs") and shown["tenant-z"]["top_client"] == "n/a"


def test_retention_keeps_the_newest(spark):
    rows = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), F.lit("t").alias("tenant_id"),
        F.timestamp_seconds(F.floor(F.col("id") / 7)).alias("created_at"),
    )
    want = [r["id"] for r in rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(123).collect()]
    for per_tenant in (False, True):
        got = {r["id"] for r in scan.retain_newest(rows, 123, per_tenant=per_tenant).collect()}
        assert got == set(want)


# --- series ------------------------------------------------------------------------


def test_gap_fill(spark):
    rows = spark.createDataFrame(
        [("tenant-a", "2026-01-01T10:00:10Z"), ("tenant-a", "2026-01-01T10:02:10Z"), ("tenant-b", "2026-01-01T10:01:10Z")],
        "tenant_id string, created_at string",
    )
    out = series.minute_series(rows, "tenant-a").orderBy("window_start").collect()
    assert [r["request_count"] for r in out] == [1, 0, 1]


def counted(spark, n, bump_from=None):
    count = F.col("id") + (F.when(F.col("id") >= bump_from, 10_000).otherwise(0) if bump_from else 0)
    return spark.range(n).select(
        F.lit("tenant-a").alias("tenant_id"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 60).alias("window_start"),
        count.alias("request_count"),
    )


@pytest.mark.parametrize("chunk", [16, 37, 10_000])
def test_windows_are_causal_and_free_of_chunk_borders(spark, chunk):
    at = lambda df: series.supervised_windows(df, chunk_minutes=chunk).where("origin_index = 30").first()
    plain, bumped = at(counted(spark, 100)), at(counted(spark, 100, 31))
    assert (plain["observed_count"], plain["lag_1"], plain["lag_5"], plain["lag_15"]) == (30, 29, 25, 15)
    assert (plain["target_5m"], plain["target_15m"]) == (35, 45)
    assert all(plain[c] == bumped[c] for c in series.INPUTS)
    whole = series.supervised_windows(counted(spark, 100)).orderBy("origin_index").collect()
    assert series.supervised_windows(counted(spark, 100), chunk_minutes=chunk).orderBy("origin_index").collect() == whole
    assert [r["origin_index"] for r in whole] == list(range(15, 85))


def test_split_purges_overlap(spark):
    split = series.chronological_split(series.supervised_windows(counted(spark, 400)))
    bounds = {r["split"]: (r["lo"], r["hi"], r["n"]) for r in split.groupBy("split").agg(
        F.min("origin_index").alias("lo"), F.max("origin_index").alias("hi"), F.count("*").alias("n")).collect()}
    assert bounds["train"][1] + 15 < bounds["test"][0]
    assert bounds["test"][2] == 370 - int(370 * 0.8)


def test_split_arguments(spark):
    windows = series.supervised_windows(counted(spark, 60))
    with pytest.raises(ValueError):
        series.chronological_split(windows, test_fraction=0.5)
    with pytest.raises(Exception, match="at least 100"):
        series.chronological_split(windows).collect()
    assert {r["split"] for r in series.chronological_split(windows, short="mark").collect()} == {"insufficient"}
