"""Isolation Forest (Liu, Ting and Zhou, ICDM 2008) with one small sample per tree.

All draws are arithmetic on hashes of row ids, trees and nodes, so a forest depends on nothing but its rows
and any engine can grow it again. Nodes are numbered as in a heap: the root is 1, the children of n are 2n and 2n + 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.session import materialise

# Number of trees, rows per tree, seed.
TREES, SAMPLE, SEED = 200, 256, 42

#: Draws are numbers below this prime, made with these factors.
PRIME, FACTOR, STEP, SALT = 2147483647, 48271, 69621, 16807
#: A share strictly between 0 and 1, in so many steps.
SHARES = 999_983
#: Decimals of a score, so that the order in which depths are added cannot show.
DIGITS = 10

TREE_SCHEMA = "tree_id int, feature array<int>, cut array<double>, depth array<double>"


@dataclass(frozen=True)
class ForestModel:
    """``trees`` has one row per tree with arrays by node number, at most 4 * SAMPLE places each."""

    trees: DataFrame
    sample: int


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def height_of(sample: int) -> int:
    return math.ceil(math.log2(max(sample, 2)))


def draw(tree: int, node: int, which: int, seed: int) -> int:
    """A number below PRIME for the ``which``-th choice at a node."""
    return ((tree * 1009 + node) * STEP + which * SALT + seed) % PRIME * FACTOR % PRIME


def sample_rows(training: DataFrame, total: int, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree_id, id, v): for each tree the ``sample`` rows with the smallest hash.

    A row is hashed once; each tree turns the hash with a factor of its own. Rows are first thinned to a
    little more than is needed, so that only about ``trees * sample`` rows are shuffled whatever the table's size.
    """
    base = (F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % PRIME).alias("base")
    turned = lambda t: (F.col("base") * ((t.cast("bigint") + 1) * FACTOR % PRIME) + seed * (t.cast("bigint") + 1)) % PRIME
    limit = min(PRIME, math.ceil(PRIME * 2.0 * sample / total))
    in_trees = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("t"), turned(t).alias("h")))
    picked = training.select("id", "v", base).select("id", "v", F.explode(F.filter(in_trees, lambda e: e["h"] < limit)).alias("e"))
    picked = picked.select("id", "v", F.col("e.t").alias("tree_id"), F.col("e.h").alias("h"))
    order = Window.partitionBy("tree_id").orderBy("h", "id")
    return picked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select("tree_id", "id", "v")


def _grow(height: int, seed: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(rows["tree_id"].iloc[0])
        data = np.vstack(rows["v"].to_numpy())
        places = 2 << height
        feature, cut = np.full(places, -1), np.zeros(places)
        depth = np.array([0.0, *(float(int(n).bit_length() - 1) for n in range(1, places))])
        todo = [(1, np.arange(len(data)))]
        while todo:
            node, members = todo.pop()
            level = node.bit_length() - 1
            part = data[members]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level >= height or len(members) < 2 or not len(usable):
                depth[node] = level + expected_depth(len(members))
                continue
            pick = int(usable[draw(tree_id, node, 1, seed) % len(usable)])
            share = (1 + draw(tree_id, node, 2, seed) % SHARES) / (SHARES + 2.0)
            feature[node], cut[node] = pick, low[pick] + (high[pick] - low[pick]) * share
            below = part[:, pick] < cut[node]
            todo += [(n, m) for n, m in ((2 * node, members[below]), (2 * node + 1, members[~below])) if len(m)]
        return pd.DataFrame({"tree_id": [tree_id], "feature": [feature.tolist()], "cut": [cut.tolist()], "depth": [depth.tolist()]})

    return build


def fit_forest(training: DataFrame, *, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> ForestModel:
    """Grow the forest from rows (id, v); every tree is built by its own task."""
    total = training.count()
    if total < 3:
        raise ValueError("at least three training windows are required")
    sample = min(sample, total)
    rows = sample_rows(training, total, trees, sample, seed)
    grown = rows.groupBy("tree_id").applyInPandas(_grow(height_of(sample), seed), TREE_SCHEMA)
    return ForestModel(materialise(grown, "trees"), sample)


def score_forest(model: ForestModel, rows: DataFrame, *, vector: str = "v", alias: str = "isolation") -> DataFrame:
    """Add the isolation score in (0, 1), larger meaning more anomalous.

    The trees are one value of bounded size (TREES * 4 * SAMPLE places at most), which a scalar subquery
    gives to every task; each row walks down its arrays, in the JVM.
    """
    scale = expected_depth(model.sample) or 1.0
    height = height_of(model.sample)
    tree = F.struct("tree_id", "feature", "cut", "depth")
    forest = model.trees.agg(F.array_sort(F.collect_list(tree))).scalar()
    v = F.col(vector)

    def walk(t):
        def down(node, _):
            split = F.get(t["feature"], node)
            right = F.when(F.get(v, split) < F.get(t["cut"], node), 0).otherwise(1)
            return F.when(split < 0, node).otherwise(2 * node + right).cast("int")

        return F.get(t["depth"], F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.lit(1), down))

    total = F.aggregate("_forest", F.lit(0.0), lambda acc, t: acc + walk(t))
    mean = total / F.size("_forest")
    score = F.round(F.pow(F.lit(2.0), -mean / F.lit(scale)), DIGITS)
    return rows.withColumn("_forest", forest).withColumn(alias, score).drop("_forest")
