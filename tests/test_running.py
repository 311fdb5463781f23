import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.operators.running import numbered, running


def rows(spark):
    """One key holds most rows; values have nulls, orders have ties and nulls."""
    rng = random.Random(3)
    made = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.choice([None, *range(400)]), i, rng.choice([None, *range(-9, 9)])) for i in range(3000)]
    return spark.createDataFrame(made, "key string, at int, id int, value long").repartition(7)


def test_places_equal_row_numbers(spark):
    df = rows(spark)
    found = numbered(df, ["key"], [F.col("at").asc_nulls_first(), F.col("id")], ["id"]).collect()
    window = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_first(), "id")
    want = df.select("key", "id", (F.row_number().over(window) - 1).alias("pos")).collect()
    assert sorted((r["key"], r["id"], r["pos"]) for r in found) == sorted(map(tuple, want))


def test_null_keys_are_numbered_too(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "key string, at int")
    found = numbered(df, ["key"], [F.col("at")], ["at"]).collect()
    assert {tuple(r) for r in found} == {(None, 1, 0), (None, 2, 1), ("a", 1, 0)}


def test_running_values_equal_one_window(spark):
    df = numbered(rows(spark), ["key"], [F.col("at").asc_nulls_first(), F.col("id")], ["id", "value"])
    kinds = {"total": "sum", "most": "max", "least": "min", "bits": "xor"}
    found = running(df, ["key"], F.floor(F.col("pos") / 50), [F.col("pos")], {n: (k, F.col("value")) for n, k in kinds.items()})
    window = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = {"total": F.sum, "most": F.max, "least": F.min, "bits": F.bit_xor}
    want = df.select(*df.columns, *[f("value").over(window).alias(n) for n, f in whole.items()])
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[3])) == sorted(map(tuple, want.collect()), key=lambda r: (r[0], r[3]))


def test_empty(spark):
    df = rows(spark).where("false")
    assert numbered(df, ["key"], [F.col("at")], ["id"]).count() == 0
    assert running(df, ["key"], F.col("at"), [F.col("at")], {"t": ("sum", F.col("value"))}).count() == 0
