"""Labelled training data: real windows labelled by rules, splits, composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import columns as C
from callscope.schemas import MODEL_FEATURES, SCENARIO_LABELS

# The split of a sample by its number, repeating.
SPLITS = ("train", "test", "train", "train")

#: From which share of a window's requests, change against the window before, or latency a rule holds.
SHARE, CHANGE, SLOW_MS = 0.5, 2.0, 900.0


def split_of(sample_index) -> F.Column:
    names = F.array(*[F.lit(s) for s in SPLITS])
    return F.element_at(names, (F.pmod(sample_index, F.lit(len(SPLITS))) + 1).cast("int"))


def scenario_of() -> F.Column:
    """The scenario of a feature window, by rules on its shares, its change and its latency."""
    rules = (
        ("HIGH_5XX_RATE", F.col("`5xx_rate`") >= SHARE),
        ("HIGH_429_RATE", F.col("`429_rate`") >= SHARE),
        ("HIGH_401_RATE", F.col("`401_rate`") >= SHARE),
        ("HIGH_LATENCY", F.col("average_latency_ms") >= SLOW_MS),
        ("TRAFFIC_SPIKE", F.col("request_rate_change") >= CHANGE),
    )
    assert all(name in SCENARIO_LABELS for name, _ in rules)
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules], F.lit("NORMAL"))


def labelled_windows(feats: DataFrame) -> DataFrame:
    """Real feature windows with scenario, label and split; ids are replaced by a hash.

    The label follows from the window itself by :func:`scenario_of`, the split from its minute.
    """
    keys = ("tenant_id", "client_id", "route_id")
    minute = F.floor(F.unix_seconds("window_start") / 60)
    rows = feats.withColumn("scenario", scenario_of())
    return rows.select(
        F.sha2(F.concat_ws("|", *keys, F.unix_seconds("window_start").cast("string")), 256).alias("id"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in MODEL_FEATURES],
        "scenario",
        F.lit(False).alias("is_synthetic"),
        (F.col("scenario") != "NORMAL").alias("is_anomaly"),
        split_of(minute).alias("split"),
        C.iso_minute("window_start").alias("window_start"),
    )


def training_union(labelled: DataFrame, historical: DataFrame) -> DataFrame:
    """Labelled samples plus real minute features as unlabelled history; ids are left out."""
    history = historical.select(
        *[F.col(f"`{c}`").cast("double").alias(c) for c in MODEL_FEATURES],
        F.lit("HISTORICAL_UNLABELED").alias("scenario"),
        F.lit(False).alias("is_synthetic"),
        F.lit(None).cast("boolean").alias("is_anomaly"),
        F.lit("unlabeled").alias("split"),
        C.iso_minute("window_start").alias("window_start"),
    )
    return labelled.select(*history.columns).unionByName(history)


def dataset_order(dataset: DataFrame) -> DataFrame:
    return dataset.orderBy("split", "scenario", "window_start")


def composition(dataset: DataFrame, *keys: str) -> DataFrame:
    """Rows, synthetic and historical counts, and the sorted scenarios present."""
    return dataset.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("is_synthetic").alias("synthetic_count"),
        F.count_if(~F.col("is_synthetic")).alias("historical_count"),
        F.array_sort(F.collect_set("scenario")).alias("scenarios"),
    )
