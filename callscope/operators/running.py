"""Places and running totals inside keys of any size: work is cut into slices, slices are chained.

A window over one key runs in one task. Here a key's rows are dealt over many: totals of
slices are few, so only they are chained key by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.session import materialise

#: How values of two neighbouring stretches are put together, by kind.
KINDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def numbered(df: DataFrame, keys: list[str], order: list[Column], keep: list, name: str = "pos") -> DataFrame:
    """The columns ``keep`` and each row's place (from 0) among the rows of its keys, in ``order``.

    Rows are dealt out by ranges of keys and order, so a key with most of the rows is
    spread over tasks; each task numbers its stretch, and the sizes of stretches are added up. Rows equal
    in keys and order may take each other's place. The result is written (it is not the same when computed anew).
    """
    nulls = [F.col(k) for k in keys]
    dealt = df.repartitionByRange(*nulls, *order).sortWithinPartitions(*nulls, *order)
    row = materialise(dealt.select(*keys, *keep, F.monotonically_increasing_id().alias("_row")), "numbered")
    part = F.shiftright("_row", 33)
    stretches = row.groupBy(*keys, part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    left, right = row.withColumn("_part", part).alias("l"), stretches.alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]])
    place = F.col("l._row") - F.col("r._first") + F.col("r._ahead")
    kept = [F.col(f"l.{c}") for c in row.columns if c != "_row"]
    return left.join(right, same).select(*kept, place.alias(name))


def running(
    df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], values: dict[str, tuple[str, Column]]
) -> DataFrame:
    """``df`` with running values from the first row of a key to this one, in ``order``.

    ``slice_of`` numbers a row's slice and must rise with the order (its number within
    the key, divided, or a stretch of time). ``values`` names the new columns: a kind of ``KINDS`` and what it
    is taken of. ``df`` is read twice, so it should be cheap or written. Keys must not be null.
    """
    sliced = df.withColumn("_slice", slice_of)
    for name, (_, value) in values.items():
        sliced = sliced.withColumn(f"_of_{name}", value)
    totals = sliced.groupBy(*keys, "_slice").agg(*[KINDS[kind][0](f"_of_{name}").alias(f"_to_{name}") for name, (kind, _) in values.items()])
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", *[KINDS[kind][0](f"_to_{name}").over(ahead).alias(f"_to_{name}") for name, (kind, _) in values.items()])
    # Only later slices are carried to: for keys of one slice nothing is joined.
    some = reduce(lambda a, b: a | b, [F.col(f"_to_{name}").isNotNull() for name in values])
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced
    for name, (kind, _) in values.items():
        out = out.withColumn(name, KINDS[kind][0](f"_of_{name}").over(inner))
    out = out.join(carry.where(some), [*keys, "_slice"], "left")
    for name, (kind, _) in values.items():
        carried, here = F.col(f"_to_{name}"), F.col(name)
        both = F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(KINDS[kind][1](carried, here))
        out = out.withColumn(name, both)
    return out.select(*df.columns, *values)
