"""Versioned detectors: parameter tables with checked metadata, and promotion."""

from __future__ import annotations

import json

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.operators.detect import ALGORITHMS, Detector
from callscope.operators.forecast import Forecaster
from callscope.operators.iforest import ForestModel
from callscope.operators.lof import LofModel
from callscope.operators.matrix import Scaler
from callscope.operators.series import INPUTS
from callscope.sources.versions import Commit, VersionedTable
from callscope.schemas import FEATURE_SCHEMA_VERSION, FORECAST_SCHEMA_VERSION, MODEL_FEATURES

METADATA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("feature_schema_version", T.StringType()),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("parameters", T.StringType()),
        T.StructField("evaluation_metrics", T.StringType()),
        T.StructField("trained_at", T.TimestampType()),
        T.StructField("checksum", T.StringType()),
    ]
)

STATUS = T.StructType(
    [
        T.StructField("model_version", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)


def table_checksum(df: DataFrame) -> str:
    """A digest of all rows, independent of their order, made by one aggregation.

    Each row's SHA-256 is cut into four numbers; the digest covers their sums and the
    row count, so equal tables agree and a changed, lost or added row shows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.sha2(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *sums), 256).alias("c")).first()["c"]


def _digest(parameters: str, tables: dict[str, DataFrame], spark: SparkSession) -> str:
    parts = [parameters, *[f"{name}={table_checksum(df)}" for name, df in sorted(tables.items())]]
    return spark.range(1).select(F.sha2(F.lit("\n".join(parts)), 256).alias("c")).first()["c"]


def save_detector(detector: Detector, path: str, metrics: dict | None = None) -> str:
    """Write the parameter table, then the metadata row that makes the version valid."""
    model = detector.model
    forest = isinstance(model, ForestModel)
    table = model.trees if forest else model.points
    spark = table.sparkSession
    table.write.mode("errorifexists").parquet(f"{path}/model")
    written = spark.read.parquet(f"{path}/model")
    parameters = json.dumps(
        {
            "threshold": detector.threshold,
            "training_rows": detector.training_rows,
            "size": model.sample if forest else model.k,
            "median": detector.scaler.median,
            "mean": detector.scaler.mean,
            "std": detector.scaler.std,
        },
        sort_keys=True,
    )
    row = (
        detector.algorithm,
        detector.version,
        FEATURE_SCHEMA_VERSION,
        list(MODEL_FEATURES),
        parameters,
        json.dumps(metrics or {}, sort_keys=True),
        None,
        _digest(parameters, {"model": written}, spark),
    )
    spark.createDataFrame([row], METADATA).withColumn("trained_at", F.current_timestamp()).write.mode("errorifexists").json(
        f"{path}/metadata"
    )
    return path


def load_detector(spark: SparkSession, path: str) -> Detector:
    """Read a version back; schema version, feature order and checksum must fit."""
    meta = spark.read.schema(METADATA).json(f"{path}/metadata").first()
    table = spark.read.parquet(f"{path}/model")
    if meta is None or meta["model_name"] not in ALGORITHMS:
        raise ValueError("unsupported model artifact")
    if meta["feature_schema_version"] != FEATURE_SCHEMA_VERSION:
        raise ValueError("unsupported feature schema")
    if list(meta["feature_names"]) != list(MODEL_FEATURES):
        raise ValueError("model feature order mismatch")
    if meta["checksum"] != _digest(meta["parameters"], {"model": table}, spark):
        raise ValueError("model artifact checksum mismatch")
    p = json.loads(meta["parameters"])
    ordered = lambda d: {c: d[c] for c in MODEL_FEATURES}
    scaler = Scaler(ordered(p["median"]), ordered(p["mean"]), ordered(p["std"]))
    model = ForestModel(table, p["size"]) if meta["model_name"] == "isolation_forest" else LofModel(table, p["size"])
    return Detector(meta["model_name"], meta["model_version"], scaler, model, p["threshold"], p["training_rows"])


FORECASTER = "random_forest_forecaster"


def save_forecaster(model: Forecaster, path: str, metrics: dict | None = None) -> str:
    """Write the forests and, last, the metadata row that makes the version valid."""
    spark = SparkSession.active()
    for horizon, forest in model.models.items():
        forest.save(f"{path}/horizon-{horizon}")
    parameters = json.dumps({"horizons": sorted(model.models)})
    row = (
        FORECASTER,
        model.version,
        FORECAST_SCHEMA_VERSION,
        list(INPUTS),
        parameters,
        json.dumps(metrics or {}, sort_keys=True),
        None,
        _digest(parameters, _forest_tables(spark, path, model.models), spark),
    )
    spark.createDataFrame([row], METADATA).withColumn("trained_at", F.current_timestamp()).write.mode("errorifexists").json(
        f"{path}/metadata"
    )
    return path


def _forest_tables(spark: SparkSession, path: str, horizons) -> dict[str, DataFrame]:
    return {str(h): spark.read.parquet(f"{path}/horizon-{h}/data") for h in horizons}


def load_forecaster(spark: SparkSession, path: str) -> Forecaster:
    meta = spark.read.schema(METADATA).json(f"{path}/metadata").first()
    if meta is None or meta["model_name"] != FORECASTER:
        raise ValueError("unsupported forecast artifact")
    if meta["feature_schema_version"] != FORECAST_SCHEMA_VERSION or list(meta["feature_names"]) != list(INPUTS):
        raise ValueError("feature schema mismatch")
    horizons = json.loads(meta["parameters"])["horizons"]
    if meta["checksum"] != _digest(meta["parameters"], _forest_tables(spark, path, horizons), spark):
        raise ValueError("artifact checksum mismatch")
    models = {h: RandomForestRegressionModel.load(f"{path}/horizon-{h}") for h in horizons}
    return Forecaster(models, meta["model_version"])


def candidate(spark: SparkSession, version: str, name: str, path: str) -> DataFrame:
    return spark.createDataFrame([(version, name, path, "candidate")], STATUS)


def promote(registry: DataFrame, version: str, *, replace: bool = False) -> DataFrame:
    """The registry with ``version`` active.

    An active version is only replaced on request and then kept as the one backup; a
    backup still in place stops the promotion.
    """
    is_it = (F.col("model_version") == version) & (F.col("status") == "candidate")
    state = registry.agg(
        F.count_if(is_it).alias("candidates"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "backup").alias("backups"),
    ).first()
    if not state["candidates"]:
        raise ValueError(f"no candidate named {version}")
    if state["active"]:
        if not replace:
            raise ValueError("an active model exists; review the candidate and pass replace=True")
        if state["backups"]:
            raise ValueError("a rollback backup exists already; archive it before replacing")
    status = (
        F.when(F.col("model_version") == version, "active")
        .when(F.col("status") == "active", "backup")
        .otherwise(F.col("status"))
    )
    return registry.withColumn("status", status)


def promote_committed(table: VersionedTable, version: str, *, replace: bool = False) -> Commit:
    """Promote in the versioned registry ``table``: the candidate is loaded and verified first, and of two
    promotions from one version the second is refused."""
    base = table.latest()
    rows = table.read(base)
    row = rows.where((F.col("model_version") == version) & (F.col("status") == "candidate")).first()
    if row is None:
        raise ValueError(f"no candidate named {version}")
    load_detector(table.spark, row["path"])
    changed = promote(rows, version, replace=replace)
    return table.rewrite(lambda _: changed, base=base)


def active_detector(spark: SparkSession, registry: DataFrame) -> Detector | None:
    """The active detector, or None; callers then report the model as unavailable."""
    row = registry.where(F.col("status") == "active").first()
    return load_detector(spark, row["path"]) if row else None
