"""Blocked windows equal plain ones, whatever the cuts."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canonry.operators.ordered import Ordered


@pytest.mark.parametrize("max_rows", [5, 10_000])
def test_equals_plain_windows(spark, max_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i // 2, i, rng.choice([None, i]), rng.randint(-2, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long, d long")
    order = [F.col("t"), F.col("i")]
    w = Window.partitionBy("k").orderBy("t", "i")
    plain = df.select(
        "i", F.row_number().over(w).cast("long").alias("n"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v"),
        F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lead("d").over(w).alias("next"), F.lag("d").over(w).alias("before"),
    )
    o = Ordered(df, ["k"], F.col("t"), order, max_rows, cuts=7, counted=df.select("k"), within=F.col("i"))
    assert o.split == (max_rows == 5)
    o.row_number("n").fill_forward(["v"]).running_sum("d", "s").lead("d", "next").lag("d", "before")
    got = o.rows().select("i", F.col("n").cast("long").alias("n"), "v", "s", "next", "before")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t long")
    assert Ordered(df, ["k"], F.col("t"), [F.col("t")]).row_number("n").rows().count() == 0


def test_one_crowded_instant_is_cut(spark):
    rows = [("hot", 7, i) for i in range(3000)] + [("hot", 9, i) for i in range(30)] + [("hot", None, i) for i in range(30)] + [("cold", 7, 1)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    o = Ordered(df, ["k"], F.col("t"), [F.col("t"), F.col("i")], 50, within=F.col("i")).row_number("n")
    sizes = [r["count"] for r in o.df.groupBy("k", "__block").count().collect()]
    assert max(sizes) < 200 and len(sizes) > 20
    w = Window.partitionBy("k").orderBy("t", "i")
    assert sorted(map(tuple, o.rows().collect()), key=str) == sorted(map(tuple, df.withColumn("n", F.row_number().over(w).cast("long")).collect()), key=str)
