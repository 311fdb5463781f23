"""Latency quantiles from stored sketches that can be merged.

Exact percentiles of an hour need its rows; a KLL sketch per minute does not. Sketches are built once, kept with the
minute features, and merged to any window or tenant. They are opt-in: with ``SIZE`` 1000 a quantile's
true rank is within ``RANK_ERROR`` of what was asked (the guarantee of the sketch is about a third of that at 99 %).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import columns as C
from callscope.operators.features import WINDOW_KEYS, valid_logs

SIZE = 1000
RANK_ERROR = 0.01


def minute_sketches(logs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """(keys, window_start, request_count, latency_sketch): one sketch of the latencies of each minute."""
    rows = valid_logs(logs).withColumn("window_start", C.minute_of("created_at"))
    sketch = F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(size))
    return rows.groupBy(*WINDOW_KEYS).agg(F.count(F.lit(1)).alias("request_count"), sketch.alias("latency_sketch"))


def roll_up(sketches: DataFrame, *keys: str | Column, size: int = SIZE) -> DataFrame:
    """Sketches merged by ``keys``: coarser windows, routes, tenants; the result can be rolled up again."""
    merged = F.kll_merge_agg_double("latency_sketch", F.lit(size)).alias("latency_sketch")
    return sketches.groupBy(*keys).agg(F.sum("request_count").alias("request_count"), merged)


def quantiles(sketches: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """One column per name in ``probabilities``, in place of the sketch."""
    found = {name: F.kll_sketch_get_quantile_double("latency_sketch", F.lit(p)) for name, p in probabilities.items()}
    return sketches.withColumns(found).drop("latency_sketch")
