"""Gap-filled minute series, causal forecasting inputs and the chronological split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import columns as C
from callscope.operators.scan import tenant_scope
from callscope.schemas import HORIZONS, LAGS, TRAILING, require_columns

REACH = max(*HORIZONS, *LAGS, *TRAILING)
MIN_WINDOWS = 100

INPUTS = (
    *(f"lag_{n}" for n in LAGS),
    *(f"rolling_{what}_{n}" for n in TRAILING for what in ("mean", "std")),
    "time_of_day_sin",
    "time_of_day_cos",
    "day_of_week_sin",
    "day_of_week_cos",
    "observed_count",
)
TARGETS = tuple(f"target_{h}m" for h in HORIZONS)


def minute_series(logs: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Requests per tenant and minute, empty minutes between first and last as 0.

    Every row with a readable time counts; status and latency are not looked at.
    """
    require_columns(logs, ("tenant_id", "created_at"))
    counts = (
        tenant_scope(logs, tenant_id)
        .select("tenant_id", C.minute_of(C.to_timestamp_or_null("created_at")).alias("window_start"))
        .where(F.col("window_start").isNotNull())
        .groupBy("tenant_id", "window_start")
        .agg(F.count(F.lit(1)).alias("request_count"))
    )
    span = counts.groupBy("tenant_id").agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    minutes = span.select(
        "tenant_id", F.explode(F.sequence("lo", "hi", F.expr("interval 1 minute"))).alias("window_start")
    )
    return minutes.join(counts, ["tenant_id", "window_start"], "left").select(
        "tenant_id", "window_start", F.coalesce("request_count", F.lit(0)).alias("request_count")
    )


def _cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def supervised_windows(series: DataFrame, *, chunk_minutes: int = 7 * 1440) -> DataFrame:
    """One row per origin minute with lags, trailing statistics, calendar terms and targets.

    ``series`` has one row for every minute of a tenant, as :func:`minute_series` gives.
    A tenant's series is cut into chunks; each chunk also receives the ``REACH`` minutes
    before and after it, so the windows sort chunks, never a whole tenant. Rows whose
    inputs or targets are incomplete are dropped.
    """
    if chunk_minutes <= REACH:
        raise ValueError(f"chunk_minutes must exceed {REACH}")
    first = series.groupBy("tenant_id").agg(F.min("window_start").alias("_first"))
    index = F.timestamp_diff("MINUTE", F.col("_first"), F.col("window_start"))
    place = F.col("origin_index") % chunk_minutes
    own = F.floor(F.col("origin_index") / chunk_minutes)
    copies = F.array_compact(
        F.array(own, F.when(place >= chunk_minutes - REACH, own + 1), F.when(place < REACH, own - 1))
    )
    rows = (
        series.join(first, "tenant_id")
        .withColumn("origin_index", index)
        .withColumn("_own", own)
        .withColumn("_chunk", F.explode(copies))
    )
    order = Window.partitionBy("tenant_id", "_chunk").orderBy("origin_index")
    value = F.col("request_count").cast("double")
    out = {f"lag_{n}": F.lag(value, n).over(order) for n in LAGS}
    for n in TRAILING:
        trailing = order.rowsBetween(-(n - 1), 0)
        full = F.col("origin_index") >= n - 1
        out[f"rolling_mean_{n}"] = F.when(full, F.avg(value).over(trailing))
        out[f"rolling_std_{n}"] = F.when(full, F.stddev_pop(value).over(trailing))
    minute = F.hour("window_start") * 60 + F.minute("window_start")
    out["time_of_day_sin"], out["time_of_day_cos"] = _cycle(minute, 1440)
    out["day_of_week_sin"], out["day_of_week_cos"] = _cycle(F.weekday("window_start"), 7)
    out["observed_count"] = value
    for h in HORIZONS:
        out[f"target_{h}m"] = F.lead(value, h).over(order)
    return (
        rows.withColumns(out)
        .where(F.col("_chunk") == F.col("_own"))
        .dropna(subset=[*INPUTS, *TARGETS])
        .select("tenant_id", F.col("window_start").alias("origin_time"), "origin_index", *INPUTS, *TARGETS)
    )


def chronological_split(windows: DataFrame, *, test_fraction: float = 0.2, short: str = "raise") -> DataFrame:
    """Add ``split``: 'train', 'test', or 'purged' where a training target reaches the test era.

    Tenants with too few windows raise an error, or get 'insufficient' with ``short='mark'``.
    """
    if not 0 < test_fraction < 0.5:
        raise ValueError("test_fraction must lie between 0 and 0.5")
    if short not in ("raise", "mark"):
        raise ValueError("short must be 'raise' or 'mark'")
    facts = windows.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("origin_index").alias("_lo")
    )
    few = F.col("_n") < MIN_WINDOWS
    # The origins of complete rows are consecutive, so a position is an offset.
    boundary = F.col("_lo") + F.floor(F.col("_n") * (1 - test_fraction))
    on_few = (
        F.lit("insufficient")
        if short == "mark"
        else F.raise_error(F.lit(f"at least {MIN_WINDOWS} supervised windows are required")).cast("string")
    )
    split = (
        F.when(few, on_few)
        .when(F.col("origin_index") >= boundary, "test")
        .when(F.col("origin_index") + max(HORIZONS) < boundary, "train")
        .otherwise("purged")
    )
    return windows.join(facts, "tenant_id").withColumn("split", split).drop("_n", "_lo")


def latest_window(windows: DataFrame) -> DataFrame:
    """The newest complete row of each tenant."""
    names = windows.columns
    newest = windows.groupBy("tenant_id").agg(F.max_by(F.struct(*names), "origin_time").alias("w"))
    return newest.select("w.*")


def by_horizon(windows: DataFrame, extra: dict[int, str] | None = None) -> DataFrame:
    """Unpivot to one row per horizon: actual, persistence baseline, optional prediction."""
    entries = [
        F.struct(
            F.lit(h).alias("horizon_minutes"),
            F.col(f"target_{h}m").alias("actual"),
            F.col("observed_count").alias("naive"),
            (F.col(extra[h]) if extra else F.lit(None).cast("double")).alias("predicted"),
        )
        for h in HORIZONS
    ]
    return windows.select("tenant_id", "origin_index", F.explode(F.array(*entries)).alias("e")).select(
        "tenant_id", "origin_index", "e.*"
    )


def forecast_errors(rows: DataFrame, *keys: str) -> DataFrame:
    """MAE and RMSE of the model and of persistence for rows of :func:`by_horizon`."""
    mae = lambda c: F.avg(F.abs(F.col("actual") - F.col(c)))
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col("actual") - F.col(c), 2)))
    return rows.groupBy(*keys, "horizon_minutes").agg(
        F.count(F.lit(1)).alias("sample_count"),
        mae("predicted").alias("mae"),
        rmse("predicted").alias("rmse"),
        mae("naive").alias("naive_mae"),
        rmse("naive").alias("naive_rmse"),
    )


def beats_persistence(errors: DataFrame, *keys: str) -> DataFrame:
    """Whether the model's MAE is below persistence at every horizon."""
    return errors.groupBy(*keys).agg(F.bool_and(F.col("mae") < F.col("naive_mae")).alias("model_beats_naive_all_horizons"))
