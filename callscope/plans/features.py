"""Registered queries: minute features and row validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.columns import time_text
from callscope.operators import features, sketches
from callscope.session import materialise
from callscope.sources import adapters as A
from callscope.sources.tables import parse_lines

QUERIES, ORACLES = {}, {}

# Checked in this container: Spark ``percentile`` and ``quantile_cont`` both interpolate linearly.
FEATURE_SQL = """windows AS (
  SELECT tenant_id, client_id, route_id, date_trunc('minute', created_at) AS window_start,
    count(*) AS request_count,
    count(*) FILTER (WHERE status_code BETWEEN 200 AND 399 AND NOT blocked) AS success_count,
    count(*) FILTER (WHERE status_code >= 400) AS error_count,
    count(*) FILTER (WHERE status_code = 401) AS count_401, count(*) FILTER (WHERE status_code = 403) AS count_403,
    count(*) FILTER (WHERE status_code = 429) AS count_429,
    count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) AS count_5xx,
    count(*) FILTER (WHERE blocked) AS blocked_count, avg(latency_ms) AS average_latency_ms,
    CAST(max(latency_ms) AS DOUBLE) AS max_latency_ms,
    quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) AS p50_latency_ms,
    quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) AS p95_latency_ms,
    CAST(count(DISTINCT method) AS INTEGER) AS unique_methods
  FROM request_logs GROUP BY 1, 2, 3, 4),
features AS (
  SELECT *, request_count AS requests_per_minute, error_count / request_count AS error_rate,
    count_401 / request_count AS "401_rate", count_403 / request_count AS "403_rate",
    count_429 / request_count AS "429_rate", count_5xx / request_count AS "5xx_rate",
    coalesce((request_count - lag(request_count) OVER w) / greatest(lag(request_count) OVER w, 1), 0.0) AS request_rate_change
  FROM windows WINDOW w AS (PARTITION BY tenant_id, client_id, route_id ORDER BY window_start))"""

ROUNDED = (
    "average_latency_ms",
    "p50_latency_ms",
    "p95_latency_ms",
    "error_rate",
    "401_rate",
    "403_rate",
    "429_rate",
    "5xx_rate",
    "request_rate_change",
)


def _rounded_sql(columns=ROUNDED) -> str:
    return ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)


def minute_features(spark, sf_dir):
    out = features.minute_features(A.request_logs(spark, sf_dir))
    return out.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ROUNDED}).withColumn(
        "window_start", time_text("window_start")
    )


QUERIES["minute_features"] = minute_features
ORACLES["minute_features"] = A.with_ctes(
    A.sql_logs(),
    FEATURE_SQL,
    f"""SELECT * REPLACE ({_rounded_sql()}, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start) FROM features""",
)


def _dirty_logs(spark, sf_dir):
    """The log as text, with every tenth kind of field damaged by a rule on the id."""
    log = A.request_logs(spark, sf_dir)
    i = F.col("id").cast("bigint")
    return log.select(
        "tenant_id",
        "client_id",
        "route_id",
        F.when(i % 41 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("method"))).alias("method"),
        F.when(i % 31 == 0, "999").otherwise(F.col("status_code").cast("string")).alias("status_code"),
        F.when(i % 37 == 0, "-5").otherwise(F.col("latency_ms").cast("string")).alias("latency_ms"),
        F.when(i % 43 == 0, "maybe").otherwise(F.col("blocked").cast("string")).alias("blocked"),
        F.when(i % 29 == 0, "not-a-time").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
    )


def rejected_rows(spark, sf_dir):
    return features.rejected_logs(_dirty_logs(spark, sf_dir)).groupBy("tenant_id", "reason").agg(
        F.count(F.lit(1)).alias("row_count")
    )


QUERIES["rejected_rows"] = rejected_rows
ORACLES["rejected_rows"] = A.with_ctes(
    A.sql_logs(),
    """SELECT tenant_id, reason, count(*) AS row_count FROM (
  SELECT tenant_id, CASE WHEN i % 29 = 0 THEN 'created_at' WHEN i % 31 = 0 THEN 'status_code' WHEN i % 37 = 0 THEN 'latency_ms'
    WHEN i % 43 = 0 THEN 'blocked' WHEN i % 41 = 0 THEN 'method' END AS reason
  FROM (SELECT *, CAST(id AS BIGINT) AS i FROM request_logs)) WHERE reason IS NOT NULL GROUP BY 1, 2""",
)


def method_mix(spark, sf_dir):
    """Valid rows of the damaged log per cleaned method."""
    return features.valid_logs(_dirty_logs(spark, sf_dir)).groupBy("tenant_id", "method").agg(
        F.count(F.lit(1)).alias("row_count")
    )


QUERIES["method_mix"] = method_mix
ORACLES["method_mix"] = A.with_ctes(
    A.sql_logs(),
    """SELECT tenant_id, method, count(*) AS row_count FROM (SELECT *, CAST(id AS BIGINT) AS i FROM request_logs)
WHERE i % 29 <> 0 AND i % 31 <> 0 AND i % 37 <> 0 AND i % 43 <> 0 AND i % 41 <> 0 GROUP BY 1, 2""",
)


def access_log_ingest(spark, sf_dir):
    """The log written as JSON lines, some cut off and some of another kind, and read back."""
    log = A.request_logs(spark, sf_dir)
    i = F.col("id").cast("bigint")
    line = F.to_json(
        F.struct(
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
            F.when(i % 19 == 0, "upstream_error").otherwise("gateway_request").alias("msg"),
            "request_id",
            "tenant_id",
            F.when(i % 5 == 0, "").otherwise(F.col("client_id")).alias("client_id"),
            F.concat(F.lit("/api/"), "route_id").alias("route"),
            "method",
            F.col("status_code").alias("response_status"),
            "latency_ms",
            F.col("blocked").alias("rate_limited"),
        )
    )
    lines = log.select(F.when(i % 23 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"))
    good, bad = parse_lines(lines)
    rows = good.select(
        "request_id", "tenant_id", "client_id", "method", "status_code", "latency_ms", "blocked", time_text("created_at").alias("created_at"), "route_path"
    )
    broken = bad.groupBy().agg(F.concat(F.lit("corrupt lines: "), F.count(F.lit(1)).cast("string")).alias("request_id"))
    return rows.unionByName(broken, allowMissingColumns=True)


QUERIES["access_log_ingest"] = access_log_ingest
ORACLES["access_log_ingest"] = A.with_ctes(
    A.sql_logs(),
    """numbered AS (SELECT *, CAST(id AS BIGINT) AS i FROM request_logs)
SELECT request_id, tenant_id, CASE WHEN i % 5 <> 0 THEN client_id END AS client_id, method, status_code, latency_ms, blocked,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, '/api/' || route_id AS route_path FROM numbered WHERE i % 19 <> 0 AND i % 23 <> 0
UNION ALL SELECT 'corrupt lines: ' || count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM numbered WHERE i % 23 = 0""",
)


def latency_rollup(spark, sf_dir):
    """Hourly and daily quantiles per tenant from stored minute sketches: whether their true ranks are within the stated error."""
    logs = A.request_logs(spark, sf_dir)
    minutes = materialise(sketches.minute_sketches(logs), "sketches")
    asked = {"p50": 0.5, "p95": 0.95}
    out = None
    hours = materialise(sketches.roll_up(minutes, "tenant_id", F.date_trunc("hour", "window_start").alias("window_start")), "hours")
    for grain, held in (("hour", hours), ("day", sketches.roll_up(hours, "tenant_id", F.date_trunc("day", "window_start").alias("window_start")))):
        estimates = sketches.quantiles(held, asked).withColumnRenamed("request_count", "sketched")
        rows = logs.select("tenant_id", F.date_trunc(grain, "created_at").alias("window_start"), "latency_ms").join(estimates, ["tenant_id", "window_start"])
        n = F.count(F.lit(1))
        within = [
            ((F.count_if(F.col("latency_ms") < F.col(c)) / n <= q + sketches.RANK_ERROR) & (F.count_if(F.col("latency_ms") <= F.col(c)) / n >= q - sketches.RANK_ERROR)).alias(f"{c}_within")
            for c, q in asked.items()
        ]
        facts = rows.groupBy("tenant_id", "window_start").agg(n.alias("request_count"), F.min("sketched").alias("sketched"), *within)
        facts = facts.withColumns({"grain": F.lit(grain), "window_start": time_text("window_start")})
        out = facts if out is None else out.unionByName(facts)
    return out


QUERIES["latency_rollup"] = latency_rollup
ORACLES["latency_rollup"] = A.with_ctes(
    A.sql_logs(),
    """SELECT tenant_id, strftime(date_trunc(grain, created_at), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS request_count, count(*) AS sketched,
  true AS p50_within, true AS p95_within, grain FROM request_logs, (VALUES ('hour'), ('day')) v(grain) GROUP BY ALL""",
)
