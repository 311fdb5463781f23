"""Anomaly detectors: training, scoring, evaluation and choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.columns import ratio
from callscope.operators import iforest, lof, matrix
from callscope.operators.quantiles import exact_quantiles
from callscope.schemas import MODEL_FEATURES
from callscope.session import materialise

ALGORITHMS = ("isolation_forest", "local_outlier_factor")
CONTAMINATION = 0.05  # fixed value
SEMANTICS = "negative decision function; a margin, not a probability"


@dataclass(frozen=True)
class Detector:
    """A fitted detector: scaler, algorithm parameters and the contamination threshold."""

    algorithm: str
    version: str
    scaler: matrix.Scaler
    model: iforest.ForestModel | lof.LofModel
    threshold: float
    training_rows: int


def _with_vector(rows: DataFrame, scaler: matrix.Scaler) -> DataFrame:
    return rows.withColumn("v", scaler.vector())


def train_detector(
    training: DataFrame,
    *,
    algorithm: str = "isolation_forest",
    version: str,
    contamination: float = CONTAMINATION,
    id_column: str = "id",
    **options,
) -> Detector:
    """Fit imputation, scaling and the detector on known-normal rows.

    The threshold is the contamination quantile of the training scores, so that this
    share of the training rows counts as anomalous.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unsupported anomaly algorithm: {algorithm}")
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must lie between 0 and 0.5")
    # Written once: fitting reads the rows several times, and they come from the log.
    rows = materialise(matrix.model_matrix(training, [F.col(id_column).cast("string").alias("id")]), "training")
    scaler = matrix.fit_scaler(rows)
    points = _with_vector(rows, scaler).select("id", "v")
    if algorithm == "isolation_forest":
        model = iforest.fit_forest(points, **options)
        scored = iforest.score_forest(model, points, alias="raw")
    else:
        model = lof.fit_lof(points, **options)
        scored = lof.training_factors(model, points).withColumnRenamed("lof", "raw")
    inner = scored.select((-F.col("raw")).alias("inner"))
    threshold = -exact_quantiles(inner, ["inner"], contamination)["inner"]
    return Detector(algorithm, version, scaler, model, threshold, rows.count())


def score(detector: Detector, rows: DataFrame) -> DataFrame:
    """The rows with ``is_anomaly``, ``score`` (margin over the threshold) and model facts.

    Keeps every input column; the model only sees the ordered feature matrix.
    """
    known = [c for c in rows.columns if c not in MODEL_FEATURES]
    frame = _with_vector(matrix.model_matrix(rows, known), detector.scaler)
    if detector.algorithm == "isolation_forest":
        scored = iforest.score_forest(detector.model, frame, alias="_raw")
    else:
        scored = lof.score_lof(detector.model, frame).withColumnRenamed("lof", "_raw")
    margin = F.col("_raw") - F.lit(detector.threshold)
    return scored.select(
        *known,
        *MODEL_FEATURES,
        (margin > 0).alias("is_anomaly_predicted"),
        margin.alias("score"),
        F.lit(SEMANTICS).alias("score_semantics"),
        F.lit(detector.version).alias("model_version"),
    )


def anomalies(scored: DataFrame) -> DataFrame:
    """The anomalous windows only, as shown to operators."""
    return scored.where(F.col("is_anomaly_predicted")).select(
        "tenant_id",
        "client_id",
        "route_id",
        "window_start",
        F.lit("ML DETECTION").alias("severity"),
        "score",
        "score_semantics",
        "model_version",
    )


def anomaly_status(tenants: DataFrame, found: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """Anomaly count and model status per tenant; without a model the count stays NULL."""
    rows = tenants.select(F.col("id").alias("tenant_id"))
    if found is None:
        none = F.lit(None)
        return rows.select(
            "tenant_id",
            none.cast("bigint").alias("anomaly_count"),
            F.lit("UNAVAILABLE").alias("status"),
            none.cast("string").alias("model_version"),
            F.lit("No active anomaly model is configured.").alias("detail"),
        )
    counts = found.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return rows.join(counts, "tenant_id", "left").select(
        "tenant_id",
        F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
        F.lit("AVAILABLE").alias("status"),
        F.lit(version).cast("string").alias("model_version"),
        F.lit(None).cast("string").alias("detail"),
    )


def confusion(rows: DataFrame, *keys: str, actual: str = "is_anomaly", predicted: str = "is_anomaly_predicted") -> DataFrame:
    """Confusion cells, precision, recall and F1 (0 where undefined); unlabelled rows are an error."""
    a, p = F.col(actual), F.col(predicted)
    checked = rows.withColumn(
        actual, F.when(a.isNull(), F.raise_error(F.lit("evaluation rows must be labelled")).cast("boolean")).otherwise(a)
    )
    cells = checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def select_model(metrics: DataFrame, *, algorithm: str = "algorithm") -> DataFrame:
    """The algorithm with the best F1, then precision; the first name wins full ties."""
    order = F.struct(F.col("f1"), F.col("precision"))
    best = metrics.agg(F.max(order).alias("_best"))
    picked = metrics.join(best, (F.col("f1") == F.col("_best.f1")) & (F.col("precision") == F.col("_best.precision")))
    return picked.agg(F.min(algorithm).alias("recommended_candidate"))


def compare_detectors(dataset: DataFrame, *, version: str, id_column: str = "id", synthetic: bool = True, **options) -> tuple[DataFrame, dict]:
    """Fit both detectors on normal training rows and measure them on the same held-out rows.

    Returns one metrics row per algorithm, and the detectors. With labels that are rules on the same features
    (``datasets.labelled_windows``) the metrics only say how well a detector finds what these rules find.
    """
    training, held_out = matrix.training_rows(dataset, synthetic=synthetic), matrix.evaluation_rows(dataset, synthetic=synthetic)
    if training.isEmpty() or held_out.isEmpty():
        raise ValueError("need NORMAL train rows and labelled test rows of that kind")
    metrics, detectors = None, {}
    for name in ALGORITHMS:
        detector = train_detector(
            training, algorithm=name, version=f"{version}-{name}", id_column=id_column, **options.get(name, {})
        )
        row = confusion(score(detector, held_out)).withColumn("algorithm", F.lit(name))
        metrics = row if metrics is None else metrics.unionByName(row)
        detectors[name] = detector
    return metrics, detectors
