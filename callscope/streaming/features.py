"""Minute features on a request-log stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callscope.operators.features import valid_logs, window_aggregates
from callscope.schemas import FEATURE_KEYS
from callscope.streaming.runs import END, use_rocksdb

DELAY = "2 minutes"


def stream_minute_features(logs: DataFrame, *, delay: str = DELAY) -> DataFrame:
    """Closed one-minute windows with counts, percentiles and rates; later rows are dropped.

    Over a stream made closable (``runs.closable``) an end mark closes the windows still open.
    """
    rows = valid_logs(logs).withWatermark("created_at", delay).where(F.col("created_at") < F.lit(END))
    keys = [*FEATURE_KEYS, F.window("created_at", "1 minute").alias("window")]
    return window_aggregates(rows, keys)


class _PreviousCount(StatefulProcessor):
    """Keeps the count of the last window of a (tenant, client, route)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("count", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("window_start")
        before = self.last.get()[0] if self.last.exists() else None
        counts = frame["request_count"].astype("int64")
        previous = counts.shift(1)
        if before is not None:
            previous.iloc[0] = before
        frame["request_rate_change"] = ((counts - previous) / previous.clip(lower=1)).fillna(0.0)
        self.last.update((int(counts.iloc[-1]),))
        yield frame

    def close(self) -> None:
        pass


def stream_rate_change(features: DataFrame) -> DataFrame:
    """Add the relative change against the previous observed window.

    ``features`` is the output of :func:`stream_minute_features`; windows close in order of
    time, so one number per key is all the state needed.
    """
    use_rocksdb(features.sparkSession)
    flat = features.withColumn("window_start", F.col("window.start")).drop("window")
    # State functions only take names that are Python names, which '401_rate' is not.
    plain = {c: f"share_{c}" for c in flat.columns if not c.isidentifier()}
    flat = flat.withColumnsRenamed(plain)
    schema = T.StructType([*flat.schema.fields, T.StructField("request_rate_change", T.DoubleType())])
    changed = flat.groupBy(*FEATURE_KEYS).transformWithStateInPandas(
        statefulProcessor=_PreviousCount(), outputStructType=schema, outputMode="Append", timeMode="None"
    )
    return changed.withColumnsRenamed({new: old for old, new in plain.items()})
