"""One-minute traffic features per tenant, client and route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import columns as C
from callscope.operators.scan import LOG_COLUMNS, tenant_scope
from callscope.schemas import FEATURE_KEYS, require_columns

WINDOW_KEYS = (*FEATURE_KEYS, "window_start")


def normalise_logs(logs: DataFrame) -> DataFrame:
    """Typed log rows: casts that turn bad text into NULL, clean method and ids.

    Columns that already have their type are passed through, so that filters on them
    still reach the scan.
    """
    require_columns(logs, LOG_COLUMNS)
    kind = {f.name: f.dataType.simpleString() for f in logs.schema}
    number = lambda c: F.col(c) if kind[c] in ("int", "bigint") else C.to_double_or_null(c)
    return logs.select(
        "tenant_id",
        C.null_to_blank("client_id").alias("client_id"),
        C.null_to_blank("route_id").alias("route_id"),
        C.clean_method("method").alias("method"),
        number("status_code").alias("status_code"),
        number("latency_ms").alias("latency_ms"),
        (F.col("blocked") if kind["blocked"] == "boolean" else C.parse_flag("blocked")).alias("blocked"),
        (F.col("created_at") if kind["created_at"] == "timestamp" else C.to_timestamp_or_null("created_at")).alias("created_at"),
    )


def row_problem():
    """Why a normalised row is unusable, or NULL."""
    return (
        F.when(F.col("created_at").isNull(), "created_at")
        .when(F.col("status_code").isNull() | ~F.col("status_code").between(100, 599), "status_code")
        .when(F.col("latency_ms").isNull() | (F.col("latency_ms") < 0), "latency_ms")
        .when(F.col("blocked").isNull(), "blocked")
        .when(F.col("method") == "", "method")
    )


def valid_logs(logs: DataFrame) -> DataFrame:
    """Normalised rows with a time, a status of 100-599, a latency >= 0, a flag and a method."""
    return normalise_logs(logs).where(
        F.col("created_at").isNotNull()
        & F.col("status_code").between(100, 599)
        & (F.col("latency_ms") >= 0)
        & F.col("blocked").isNotNull()
        & (F.col("method") != "")
    )


def rejected_logs(logs: DataFrame) -> DataFrame:
    """The rows :func:`valid_logs` leaves out, each with the first reason found."""
    return normalise_logs(logs).withColumn("reason", row_problem()).where(F.col("reason").isNotNull())


def _aggregates(percentiles: str, method_set) -> list:
    status, latency = F.col("status_code"), F.col("latency_ms")
    if percentiles == "exact":
        p50, p95 = F.percentile(latency, F.lit(0.5)), F.percentile(latency, F.lit(0.95))
    elif percentiles == "approximate":
        p50, p95 = F.approx_percentile(latency, F.lit(0.5)), F.approx_percentile(latency, F.lit(0.95))
    else:
        raise ValueError("percentiles must be 'exact' or 'approximate'")
    return [
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(C.is_success()).alias("success_count"),
        F.count_if(C.is_error()).alias("error_count"),
        F.count_if(status == 401).alias("count_401"),
        F.count_if(status == 403).alias("count_403"),
        F.count_if(status == 429).alias("count_429"),
        F.count_if(C.is_server_error()).alias("count_5xx"),
        F.count_if("blocked").alias("blocked_count"),
        F.avg(latency).alias("average_latency_ms"),
        F.max(latency).cast("double").alias("max_latency_ms"),
        p50.alias("p50_latency_ms"),
        p95.alias("p95_latency_ms"),
        F.size(method_set).alias("unique_methods"),
    ]


def window_aggregates(rows: DataFrame, keys, percentiles: str = "exact") -> DataFrame:
    """Counts, latency statistics and rates for valid rows grouped by ``keys``.

    One aggregation: distinct methods come from a set (a handful of values) and the
    exact percentiles from value counts, so both combine on the map side and their
    state is bounded by distinct latencies, not by rows. No separate merge is needed.
    Works on batch and streaming input alike.
    """
    total = F.col("request_count")
    return rows.groupBy(*keys).agg(*_aggregates(percentiles, F.collect_set("method"))).withColumns(
        {
            "requests_per_minute": total,
            "error_rate": F.col("error_count") / total,
            "401_rate": F.col("count_401") / total,
            "403_rate": F.col("count_403") / total,
            "429_rate": F.col("count_429") / total,
            "5xx_rate": F.col("count_5xx") / total,
        }
    )


def rate_change(features: DataFrame) -> DataFrame:
    """Relative change of the count against the previous observed window; first is 0."""
    order = Window.partitionBy(*FEATURE_KEYS).orderBy("window_start")
    previous = F.lag("request_count").over(order)
    change = (F.col("request_count") - previous) / F.greatest(previous, F.lit(1))
    return features.withColumn("request_rate_change", F.coalesce(change, F.lit(0.0)))


def minute_features(
    logs: DataFrame, tenant_id: str | None = None, *, percentiles: str = "exact", valid: bool = False
) -> DataFrame:
    """Minute features of one tenant or of all tenants; windows without requests are absent.

    Two exchanges: partial aggregates by the four keys, then one row per minute by the
    three keys for the previous window.
    """
    rows = tenant_scope(logs, tenant_id)
    rows = rows if valid else valid_logs(rows)
    rows = rows.withColumn("window_start", C.minute_of("created_at"))
    return rate_change(window_aggregates(rows, WINDOW_KEYS, percentiles))


def with_iso_window(features: DataFrame) -> DataFrame:
    return features.withColumn("window_start", C.iso_minute("window_start"))
