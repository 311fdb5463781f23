"""The ordered model matrix, median imputation and standardising."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions import columns as C
from callscope.operators.quantiles import exact_quantiles
from callscope.schemas import MODEL_FEATURES, require_columns


def model_matrix(rows: DataFrame, keep=(), *, features=MODEL_FEATURES, on_empty: str = "raise") -> DataFrame:
    """``keep`` plus the model features in their fixed order, as doubles.

    Text that is no number and infinities become NULL. Rows without any usable number
    stop the job, or come back through :func:`unusable_rows` with ``on_empty='drop'``.
    """
    require_columns(rows, features)
    numbers = rows.select(*keep, *[C.to_double_or_null(c).alias(c) for c in features])
    usable = F.coalesce(*features).isNotNull()
    if on_empty == "drop":
        return numbers.where(usable)
    if on_empty != "raise":
        raise ValueError("on_empty must be 'raise' or 'drop'")
    first = features[0]
    failed = F.raise_error(F.lit("model input row has no usable numeric features")).cast("double")
    return numbers.withColumn(first, F.when(usable, F.col(first)).otherwise(failed))


def unusable_rows(rows: DataFrame, features=MODEL_FEATURES) -> DataFrame:
    return rows.where(F.coalesce(*[C.to_double_or_null(c) for c in features]).isNull())


@dataclass(frozen=True)
class Scaler:
    """Fitted medians, means and population deviations, by feature."""

    median: dict
    mean: dict
    std: dict

    @property
    def features(self) -> tuple:
        return tuple(self.median)

    def column(self, name: str):
        filled = F.coalesce(F.col(name), F.lit(self.median[name]))
        return (filled - F.lit(self.mean[name])) / F.lit(self.std[name])

    def columns(self, digits: int | None = None) -> list:
        """One standardised column per feature."""
        cols = [(self.column(c), c) for c in self.features]
        return [(F.round(z, digits) + F.lit(0.0) if digits else z).alias(c) for z, c in cols]

    def vector(self, digits: int = 9):
        """All standardised features as one array, rounded so that equal rows stay equal."""
        return F.array(*[F.round(self.column(c), digits) + F.lit(0.0) for c in self.features])


def fit_scaler(training: DataFrame, features=MODEL_FEATURES) -> Scaler:
    """Exact medians, then mean and population deviation of the filled columns.

    Fitted values are one row of numbers; a constant column gets deviation 1, a column
    without any value counts as 0.
    """
    medians = {c: (0.0 if v is None else v) for c, v in exact_quantiles(training, features, 0.5).items()}
    filled = {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in features}
    stats = training.agg(
        *[F.avg(v).alias(f"m_{c}") for c, v in filled.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items()]
    ).first()
    mean = {c: stats[f"m_{c}"] for c in features}
    std = {c: stats[f"s_{c}"] if stats[f"s_{c}"] else 1.0 for c in features}
    return Scaler(medians, mean, std)


def training_rows(dataset: DataFrame, *, synthetic: bool = True) -> DataFrame:
    """Known-normal training rows, synthetic ones or real ones that were labelled."""
    require_columns(dataset, ("split", "scenario", "is_synthetic", "is_anomaly"))
    return dataset.where((F.col("split") == "train") & (F.col("scenario") == "NORMAL") & (F.col("is_synthetic") == synthetic))


def evaluation_rows(dataset: DataFrame, *, synthetic: bool = True) -> DataFrame:
    """Labelled held-out rows, synthetic or real."""
    require_columns(dataset, ("split", "scenario", "is_synthetic", "is_anomaly"))
    return dataset.where((F.col("split") == "test") & (F.col("is_synthetic") == synthetic) & F.col("is_anomaly").isNotNull())
