"""Registered queries: minute series and forecasting inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.columns import time_text
from callscope.operators import series as S
from callscope.sources import adapters as A

QUERIES, ORACLES = {}, {}

SERIES_SQL = """counts AS (SELECT tenant_id, date_trunc('minute', created_at) AS window_start, count(*) AS n FROM request_logs GROUP BY 1, 2),
minutes AS (SELECT tenant_id, unnest(generate_series(min(window_start), max(window_start), INTERVAL 1 MINUTE)) AS window_start
  FROM counts GROUP BY 1),
series AS (SELECT m.tenant_id, m.window_start, coalesce(c.n, 0) AS request_count FROM minutes m
  LEFT JOIN counts c ON c.tenant_id = m.tenant_id AND c.window_start = m.window_start)"""

WINDOWS_SQL = """indexed AS (SELECT tenant_id, window_start AS origin_time, row_number() OVER w - 1 AS origin_index, CAST(request_count AS DOUBLE) AS v,
    hour(window_start) * 60 + minute(window_start) AS m, isodow(window_start) - 1 AS d
  FROM series WINDOW w AS (PARTITION BY tenant_id ORDER BY window_start)),
wide AS (SELECT tenant_id, origin_time, origin_index, lag(v, 1) OVER w AS lag_1, lag(v, 5) OVER w AS lag_5, lag(v, 15) OVER w AS lag_15,
    CASE WHEN origin_index >= 4 THEN avg(v) OVER w5 END AS rolling_mean_5, CASE WHEN origin_index >= 4 THEN stddev_pop(v) OVER w5 END AS rolling_std_5,
    CASE WHEN origin_index >= 14 THEN avg(v) OVER w15 END AS rolling_mean_15, CASE WHEN origin_index >= 14 THEN stddev_pop(v) OVER w15 END AS rolling_std_15,
    sin(2 * pi() * m / 1440) AS time_of_day_sin, cos(2 * pi() * m / 1440) AS time_of_day_cos,
    sin(2 * pi() * d / 7) AS day_of_week_sin, cos(2 * pi() * d / 7) AS day_of_week_cos,
    v AS observed_count, lead(v, 5) OVER w AS target_5m, lead(v, 15) OVER w AS target_15m
  FROM indexed WINDOW w AS (PARTITION BY tenant_id ORDER BY origin_index),
    w5 AS (PARTITION BY tenant_id ORDER BY origin_index ROWS 4 PRECEDING),
    w15 AS (PARTITION BY tenant_id ORDER BY origin_index ROWS 14 PRECEDING)),
complete AS (SELECT * FROM wide WHERE lag_15 IS NOT NULL AND rolling_mean_15 IS NOT NULL AND target_15m IS NOT NULL)"""

SPLIT_SQL = """bounds AS (SELECT tenant_id, min(origin_index) + CAST(floor(count(*) * (1 - 0.2::DOUBLE)) AS BIGINT) AS b FROM complete GROUP BY 1),
splits AS (SELECT c.*, CASE WHEN origin_index >= b THEN 'test' WHEN origin_index + 15 < b THEN 'train' ELSE 'purged' END AS split
  FROM complete c JOIN bounds USING (tenant_id))"""

FLOATS = [c for c in S.INPUTS if c.startswith(("rolling", "time", "day"))]
BASE = (A.sql_logs(60), SERIES_SQL)


def _series(spark, sf_dir):
    return S.minute_series(A.request_logs(spark, sf_dir, 60))


def minute_series(spark, sf_dir):
    return _series(spark, sf_dir).withColumn("window_start", time_text("window_start"))


QUERIES["minute_series"] = minute_series
ORACLES["minute_series"] = A.with_ctes(
    *BASE, "SELECT tenant_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, request_count FROM series"
)


def supervised_windows(spark, sf_dir):
    # Chunks shorter than the series, so that the borders between chunks are exercised.
    out = S.supervised_windows(_series(spark, sf_dir), chunk_minutes=240)
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in FLOATS}).withColumn("origin_time", time_text("origin_time"))


QUERIES["supervised_windows"] = supervised_windows
ORACLES["supervised_windows"] = A.with_ctes(
    *BASE,
    WINDOWS_SQL,
    "SELECT * REPLACE (strftime(origin_time, '%Y-%m-%d %H:%M:%S') AS origin_time, "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FLOATS)
    + ") FROM complete",
)


def chronological_split(spark, sf_dir):
    out = S.chronological_split(S.supervised_windows(_series(spark, sf_dir)), short="mark")
    return out.select("tenant_id", "origin_index", "split")


QUERIES["chronological_split"] = chronological_split
ORACLES["chronological_split"] = A.with_ctes(
    *BASE, WINDOWS_SQL, SPLIT_SQL, "SELECT tenant_id, origin_index, split FROM splits"
)


def latest_window(spark, sf_dir):
    out = S.latest_window(S.supervised_windows(_series(spark, sf_dir)))
    return out.select("tenant_id", time_text("origin_time").alias("origin_time"), "origin_index", "observed_count", "lag_15")


QUERIES["latest_window"] = latest_window
ORACLES["latest_window"] = A.with_ctes(
    *BASE,
    WINDOWS_SQL,
    """SELECT tenant_id, strftime(origin_time, '%Y-%m-%d %H:%M:%S') AS origin_time, origin_index, observed_count, lag_15
FROM complete QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY complete.origin_time DESC) = 1""",
)


def forecast_baseline_metrics(spark, sf_dir):
    split = S.chronological_split(S.supervised_windows(_series(spark, sf_dir)), short="mark")
    out = S.forecast_errors(S.by_horizon(split.where(F.col("split") == "test")), "tenant_id")
    return out.select(
        "tenant_id",
        "horizon_minutes",
        "sample_count",
        F.round("naive_mae", 6).alias("naive_mae"),
        F.round("naive_rmse", 6).alias("naive_rmse"),
    )


def _errors_sql(h: int) -> str:
    return f"""SELECT tenant_id, CAST({h} AS INTEGER) AS horizon_minutes, count(*) AS sample_count,
  round(avg(abs(target_{h}m - observed_count)), 6) AS naive_mae,
  round(sqrt(avg(pow(target_{h}m - observed_count, 2))), 6) AS naive_rmse FROM splits WHERE split = 'test' GROUP BY 1"""


QUERIES["forecast_baseline_metrics"] = forecast_baseline_metrics
ORACLES["forecast_baseline_metrics"] = A.with_ctes(
    *BASE, WINDOWS_SQL, SPLIT_SQL, _errors_sql(5) + "\nUNION ALL " + _errors_sql(15)
)
