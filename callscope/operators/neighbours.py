"""Exact k nearest neighbours between two sets of vectors, without comparing all pairs.

A fixed number of pivots parts the points into cells (each point belongs to its nearest pivot), and cells into rings by the
distance to the pivot. A query first searches the ring it lies in itself, which bounds the
distance to its k-th neighbour. Then only cells and rings are searched that may hold closer points: the
hyperplane between two pivots and the ring's inner and outer edge bound the distance from below.
Equal vectors must be merged beforehand (``w`` counts the copies), so no ring is
dominated by copies of one vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.session import materialise

#: Points that a ring should hold, and the most pivots and rings of a cell there are, whatever the number of points.
BUCKET_ROWS = 4096
PIVOTS, RINGS = 256, 16
SPLIT_ROWS = 20_000
DIGITS = 8
_BLOCK = 256
_EDGE = 1e-6  # slack for rounded distances at edges

_FOUND = "qid string, radius double, pid array<string>, w array<bigint>, d array<double>"


def merge_equal(points: DataFrame) -> DataFrame:
    """Distinct vectors ``v`` with the smallest id as ``pid`` and the number of copies ``w``."""
    return points.groupBy("v").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w"))


def _search(k: int, exclude_self: bool):
    def run(queries: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of one bucket for each query, ties by reference id."""
        if not len(queries) or not len(reference):
            return pd.DataFrame({"qid": [], "radius": [], "pid": [], "w": [], "d": []})
        reference = reference.sort_values("pid")
        points, pid = np.vstack(reference["held_v"].to_numpy()), reference["pid"].to_numpy()
        copies = reference["w"].to_numpy()
        asked, qid = np.vstack(queries["v"].to_numpy()), queries["qid"].to_numpy()
        bound = queries["radius"].to_numpy()
        out = []
        for at in range(0, len(asked), _BLOCK):
            block = asked[at : at + _BLOCK]
            square = np.zeros((len(block), len(points)))
            for j in range(points.shape[1]):
                square += (block[:, j, None] - points[None, :, j]) ** 2
            distance = np.round(np.sqrt(square), DIGITS)
            nearest = np.argsort(distance, axis=1, kind="stable")[:, : k + 1]
            for i, order in enumerate(nearest):
                me = qid[at + i]
                weights = copies[order].copy()
                if exclude_self:
                    weights[pid[order] == me] -= 1
                here = (weights > 0) & (distance[i, order] <= bound[at + i])
                order, weights = order[here], weights[here]
                upto = np.cumsum(weights)
                full = np.searchsorted(upto, k)
                radius = distance[i, order[full]] if full < len(order) else math.inf
                stop = full + 1
                out.append((me, radius, pid[order[:stop]], weights[:stop], distance[i, order[:stop]]))
        return pd.DataFrame(out, columns=["qid", "radius", "pid", "w", "d"])

    return run


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(pivots)))
    for j in range(pivots.shape[1]):
        out += (points[:, j, None] - pivots[None, :, j]) ** 2
    return np.sqrt(out)


def _placed(rows: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the distances to all pivots, the nearest one as ``cell``, and the distance to it as ``away``."""

    def run(frames):
        for frame in frames:
            if len(frame):
                far = _distances(np.vstack(frame[vector].to_numpy()), pivots)
                cell = far.argmin(axis=1)
                yield frame.assign(far=list(far), cell=cell.astype(np.int32), away=far[np.arange(len(far)), cell])

    kind = T.StructType([*rows.schema.fields]).add("far", T.ArrayType(T.DoubleType())).add("cell", T.IntegerType()).add("away", T.DoubleType())
    return rows.mapInPandas(run, kind)


def _visit(queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool, split_rows: int, bucket_rows: int) -> DataFrame:
    """Search ring ``bucket`` of each query.

    Rings with many queries or many points are searched by several tasks: queries are
    dealt out to parts, points to shares, and every part meets every share. The table of
    sizes has one row per ring.
    """
    zero = F.lit(0).cast("bigint")
    parts = queries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / split_rows).alias("parts"))
    shares = reference.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / (2 * bucket_rows)).alias("shares"))
    sizes = parts.join(shares, "bucket")
    asked = (
        queries.join(sizes, "bucket")
        .withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
        .withColumn("share", F.explode(F.sequence(zero, F.col("shares") - 1)))
    )
    held = (
        reference.join(sizes, "bucket")
        .withColumn("share", F.pmod(F.xxhash64("pid"), F.col("shares")))
        .withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    )
    keys = ["bucket", "part", "share"]
    return (
        asked.select("qid", "v", "radius", *keys)
        .groupBy(*keys)
        .cogroup(held.select("pid", "held_v", "w", *keys).groupBy(*keys))
        .applyInPandas(_search(k, exclude_self), _FOUND)
    )


def nearest(
    reference: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    exclude_self: bool = False,
    bucket_rows: int = BUCKET_ROWS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """(qid, pid, w, d): the k nearest of every query, ``w`` summing to k, ties by pid.

    ``reference`` has (pid, v, w), ``queries`` (qid, v). With ``exclude_self`` a query is
    not its own neighbour, but further copies of it are.
    """
    first, second = visits(reference, queries, k, exclude_self=exclude_self, bucket_rows=bucket_rows, split_rows=split_rows)
    return _closest(first if second is None else first.unionByName(second[0]), k)


def visits(
    reference: DataFrame, queries: DataFrame, k: int, *, exclude_self: bool, bucket_rows: int, split_rows: int
) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """What each query finds in its own ring, and in the other rings it has to search, with the list of these visits."""
    if k < 1:
        raise ValueError("k must be positive")
    held = reference.select(F.col("pid").cast("string").alias("pid"), F.col("v").cast("array<double>").alias("held_v"), "w")
    asked = queries.select(F.col("qid").cast("string").alias("qid"), F.col("v").cast("array<double>").alias("v"))
    count = held.count()
    if not count:
        raise ValueError("the reference set is empty")
    wanted = min(PIVOTS, max(1, math.isqrt(math.ceil(count / bucket_rows))))
    rings = min(RINGS, math.ceil(count / bucket_rows / wanted))
    if wanted == rings == 1:
        one = F.lit(0).alias("bucket")
        asked, held = asked.select("*", F.lit(math.inf).alias("radius"), one), held.select("*", one)
        return _visit(asked, held, k, exclude_self, split_rows, bucket_rows), None
    chosen = held.select("held_v", F.xxhash64("pid").alias("h")).orderBy("h", "held_v").limit(wanted).collect()
    pivots = np.array([r["held_v"] for r in chosen])
    between = _distances(pivots, pivots)
    held = materialise(_placed(held, "held_v", pivots).drop("far"), "reference")
    # A few edges for each of a bounded number of cells; they need not be exact, the bounds below are.
    edges = held.groupBy("cell").agg(F.approx_percentile("away", [i / rings for i in range(1, rings)] or [0.5], 1000).alias("edges"))
    ring = lambda df: df.withColumn("bucket", F.col("cell") * rings + F.least(F.size(F.filter("edges", lambda e: e < F.col("away"))), F.lit(rings - 1)))
    held = ring(held.join(edges, "cell")).drop("edges")
    asked = ring(_placed(asked, "v", pivots).join(edges, "cell")).drop("edges")
    asked, held = materialise(asked, "queries"), materialise(held, "reference")
    own = asked.select("qid", "v", "bucket", F.lit(math.inf).alias("radius"))
    first = materialise(_visit(own, held, k, exclude_self, split_rows, bucket_rows), "neighbours")
    radius = first.groupBy("qid").agg(F.min("radius").alias("radius"))
    reach = asked.join(radius, "qid", "left").withColumn("radius", F.coalesce("radius", F.lit(math.inf)))

    def open_cells(frames):
        """The cells that a query's radius may reach into, with the distance to their pivots."""
        for frame in frames:
            if not len(frame):
                continue
            far, cell, radius = np.vstack(frame["far"].to_numpy()), frame["cell"].to_numpy(), frame["radius"].to_numpy()
            apart = between[cell]
            edge = (far**2 - frame["away"].to_numpy()[:, None] ** 2) / np.where(apart > 0, 2 * apart, 1.0)
            query, other = np.nonzero((edge <= radius[:, None] + _EDGE) | (apart == 0))
            chosen = frame.iloc[query][["qid", "v", "radius", "bucket"]].rename(columns={"bucket": "own"})
            yield chosen.assign(cell=other.astype(np.int32), pivot_away=far[query, other])

    opened = reach.mapInPandas(open_cells, "qid string, v array<double>, radius double, own int, cell int, pivot_away double")
    bounds = held.groupBy("cell", "bucket").agg(F.min("away").alias("inner"), F.max("away").alias("outer"))
    near = (F.col("pivot_away") - F.col("radius") - _EDGE <= F.col("outer")) & (F.col("pivot_away") + F.col("radius") + _EDGE >= F.col("inner"))
    others = opened.join(bounds, "cell").where(near & (F.col("bucket") != F.col("own"))).select("qid", "v", "radius", "bucket")
    others = materialise(others, "visits")
    return first, (_visit(others, held, k, exclude_self, split_rows, bucket_rows), others.join(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("points")), "bucket"))


def _closest(found: DataFrame, k: int) -> DataFrame:
    rows = found.select("qid", F.explode(F.arrays_zip("pid", "w", "d")).alias("n")).select("qid", "n.*")
    upto = F.sum("w").over(Window.partitionBy("qid").orderBy("d", "pid").rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("_before", upto - F.col("w"))
        .where(F.col("_before") < k)
        .select("qid", "pid", F.least("w", k - F.col("_before")).alias("w"), "d")
    )
