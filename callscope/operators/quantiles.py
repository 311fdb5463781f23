"""Exact quantiles of many columns by radix selection.

Numbers become 64-bit keys in the order of the numbers. A pass counts the next 16 bits of the keys that share the
digits found so far, for all columns at once: at most 2 ** 16 counters for a column and rank, summed map-side.
Four passes find any rank exactly, whatever the values or their number; no value is ranked or moved.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.columns import as_col

DIGIT = 16
PASSES = 64 // DIGIT
_SIGN = -(2**63)


def order_key(c) -> Column:
    """The bits of a double, turned so that they order as unsigned numbers do; NULL and NaN have none."""
    x = F.nanvl(as_col(c).cast("double"), F.lit(None).cast("double"))
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x + F.lit(0.0)).cast("bigint")
    return F.when(x.isNotNull(), F.when(x < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(_SIGN))))


def number_of(key: int) -> float:
    """The double whose key has these 64 bits."""
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return struct.unpack(">d", bits.to_bytes(8, "big"))[0]


def exact_quantiles(df: DataFrame, columns, probability: float) -> dict[str, float | None]:
    """Linear-interpolated quantile of each column, NULLs and NaNs left out; None for a column without values."""
    columns = list(columns)
    entries = F.array(*[F.struct(F.lit(i).alias("i"), order_key(c).alias("key")) for i, c in enumerate(columns)])
    keys = df.select(F.explode(entries).alias("e")).select("e.*").where("key is not null")
    # (column, rank) -> digits found so far, and the rank among the keys that share them.
    found: dict[tuple[int, int], tuple[int, int]] = {}
    places: dict[int, float] = {}
    for number in range(PASSES):
        shift = 64 - DIGIT * (number + 1)
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")
        if number == 0:
            counts = keys.select("i", F.lit(0).cast("bigint").alias("head"), digit)
        else:
            heads = [sorted({head for (j, _), (head, _) in found.items() if j == i}) for i in range(len(columns))]
            known = F.array(*[F.array(*[F.lit(_signed(h)) for h in own]).cast("array<bigint>") for own in heads])
            head = F.shiftrightunsigned("key", shift + DIGIT).alias("head")
            counts = keys.select("i", head, digit).where(F.array_contains(F.get(known, F.col("i")), F.col("head")))
        counts = counts.groupBy("i", "head", "digit").agg(F.count(F.lit(1)).alias("n"))
        ahead = Window.partitionBy("i", "head").orderBy("digit")
        counts = counts.withColumn("upto", F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
        if number == 0:
            # The first pass counts all values, so it also gives the ranks; its counters are bounded.
            counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("i")))
            wanted = F.lit(False)
            place = (F.col("total") - 1) * F.lit(probability)
            for rank in (F.floor(place), F.ceil(place)):
                wanted |= (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        else:
            wanted = F.lit(False)
            for (i, _), (head, rank) in found.items():
                wanted |= (F.col("i") == i) & (F.col("head") == _signed(head)) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        hits = counts.where(wanted).collect()
        if number == 0:
            places = {r["i"]: (r["total"] - 1) * probability for r in hits}
            found = {(i, rank): (0, rank) for i, place in places.items() for rank in {math.floor(place), math.ceil(place)}}
        found = {
            key: next(((head << DIGIT | r["digit"], rank - (r["upto"] - r["n"])) for r in hits if r["i"] == key[0] and r["head"] == _signed(head) and r["upto"] - r["n"] <= rank < r["upto"]))
            for key, (head, rank) in found.items()
        }
    out: dict[str, float | None] = dict.fromkeys(columns)
    for i, place in places.items():
        low, high = (number_of(found[(i, rank)][0]) for rank in (math.floor(place), math.ceil(place)))
        out[columns[i]] = low if low == high else low + (high - low) * (place - math.floor(place))
    return out


def _signed(head: int) -> int:
    return head - (1 << 64) if head >> 63 else head
