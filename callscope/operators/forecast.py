"""Two forest regressors for the count 5 and 15 minutes ahead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import series as S
from callscope.schemas import HORIZONS

# Trees, smallest leaf, seed.
TREES, MIN_LEAF, SEED = 100, 2, 42


@dataclass(frozen=True)
class Forecaster:
    models: dict[int, RandomForestRegressionModel]
    version: str


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(S.INPUTS), outputCol="inputs").transform(df)


def _predicted(model: Forecaster, windows: DataFrame) -> DataFrame:
    out = _vector(windows)
    for h, forest in model.models.items():
        out = forest.transform(out).withColumn(f"predicted_{h}m", F.greatest("prediction", F.lit(0.0))).drop("prediction")
    return out.drop("inputs")


def train_forecaster(
    windows: DataFrame, *, version: str = "forecast-v1", depth: int = 15, trees: int = TREES, short: str = "raise"
) -> tuple[Forecaster, DataFrame]:
    """Fit on the training era of all tenants and measure on the test era.

    Returns the forecaster and, per horizon, MAE and RMSE next to persistence.
    """
    split = S.chronological_split(windows, short=short)
    training = _vector(split.where(F.col("split") == "train"))
    models = {
        h: RandomForestRegressor(
            featuresCol="inputs",
            labelCol=f"target_{h}m",
            numTrees=trees,
            minInstancesPerNode=MIN_LEAF,
            seed=SEED,
            featureSubsetStrategy="all",
            maxDepth=depth,
        ).fit(training)
        for h in HORIZONS
    }
    model = Forecaster(models, version)
    tested = _predicted(model, split.where(F.col("split") == "test"))
    return model, S.forecast_errors(S.by_horizon(tested, {h: f"predicted_{h}m" for h in HORIZONS}))


def forecast(model: Forecaster, windows: DataFrame) -> DataFrame:
    """For the newest window of each tenant one row per horizon, never below 0."""
    latest = _predicted(model, S.latest_window(windows))
    entries = F.array(
        *[F.struct(F.lit(h).alias("horizon_minutes"), F.col(f"predicted_{h}m").alias("predicted_requests")) for h in model.models]
    )
    return latest.select("tenant_id", "origin_time", "observed_count", F.explode(entries).alias("e")).select(
        "tenant_id",
        "e.horizon_minutes",
        F.timestamp_add("MINUTE", F.col("e.horizon_minutes"), F.col("origin_time")).alias("forecast_time"),
        F.col("observed_count").alias("observed_at_origin"),
        "e.predicted_requests",
        F.col("observed_count").alias("naive_persistence_requests"),
        F.lit(model.version).alias("model_version"),
        F.lit("model_prediction").alias("value_kind"),
    )


def no_forecast(tenants: DataFrame) -> DataFrame:
    """The answer where no forecaster is active: no invented numbers."""
    return tenants.select(
        F.col("id").alias("tenant_id"),
        F.lit("UNAVAILABLE").alias("status"),
        F.lit(None).cast("string").alias("model_version"),
        F.lit(
            "The forecasting model is trained and evaluated offline; no live forecast artifact is activated."
        ).alias("note"),
    )
