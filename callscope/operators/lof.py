"""Local Outlier Factor (Breunig et al., SIGMOD 2000) on exact nearest neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.neighbours import merge_equal, nearest
from callscope.session import materialise

MAX_NEIGHBOURS = 20  # fixed value
_TINY = 1e-10  # fixed value: keeps the density of exact copies finite


@dataclass(frozen=True)
class LofModel:
    """Distinct reference vectors with copies, k-distance, density and own factor."""

    points: DataFrame  # pid, v, w, k_distance, lrd, lof
    k: int


def fit_lof(training: DataFrame, *, max_neighbours: int = MAX_NEIGHBOURS, **search) -> LofModel:
    """Fit on (id, v). Every row counts; equal vectors are held once with their number."""
    total = training.count()
    if total < 3:
        raise ValueError("at least three training windows are required")
    k = min(max_neighbours, total - 1)
    points = materialise(merge_equal(training.select(F.col("id").cast("string").alias("id"), "v")), "lof-points")
    links = materialise(
        nearest(points, points.select(F.col("pid").alias("qid"), "v"), k, exclude_self=True, **search), "lof-links"
    )
    reach = links.groupBy("qid").agg(F.max("d").alias("k_distance"))
    density = materialise(_density(links, reach, k).join(reach, "qid"), "lof-density")
    factors = _factor(links, density.select(F.col("qid").alias("pid"), "lrd"), density.select("qid", "lrd"), k)
    model = points.join(density.withColumnRenamed("qid", "pid"), "pid").join(factors.withColumnRenamed("qid", "pid"), "pid")
    return LofModel(materialise(model.select("pid", "v", "w", "k_distance", "lrd", "lof"), "lof-model"), k)


def _density(links: DataFrame, reach: DataFrame, k: int) -> DataFrame:
    """Local reachability density of every query of ``links``."""
    far = reach.select(F.col("qid").alias("pid"), "k_distance")
    mean = F.sum(F.col("w") * F.greatest("d", "k_distance")) / k
    return links.join(far, "pid").groupBy("qid").agg((1 / (mean + _TINY)).alias("lrd"))


def _factor(links: DataFrame, held: DataFrame, own: DataFrame, k: int) -> DataFrame:
    mean = links.join(held.select("pid", "lrd"), "pid").groupBy("qid").agg((F.sum(F.col("w") * F.col("lrd")) / k).alias("around"))
    return mean.join(own, "qid").select("qid", (F.col("around") / F.col("lrd")).alias("lof"))


def training_factors(model: LofModel, training: DataFrame) -> DataFrame:
    """The factor of every training row (a row is not its own neighbour)."""
    return training.join(model.points.select("v", "lof"), "v")


def score_lof(model: LofModel, rows: DataFrame, **search) -> DataFrame:
    """Add ``lof`` to rows with a vector ``v``; each distinct vector is scored once."""
    asked = rows.select("v").distinct().select(
        F.sha2(F.to_json(F.struct("v")), 256).alias("qid"), "v"
    )
    links = materialise(nearest(model.points, asked, model.k, **search), "lof-links")
    reach = model.points.select(F.col("pid").alias("qid"), "k_distance")
    density = _density(links, reach, model.k)
    factors = _factor(links, model.points, density, model.k)
    return rows.join(asked.join(factors, "qid").select("v", "lof"), "v")
