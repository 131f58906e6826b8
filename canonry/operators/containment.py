"""Names of which one contains the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the pieces that longer names are found by.
_PIECE = 3


def _pieces(name: str, size: int) -> Column:
    """The distinct pieces of `size` characters of a name."""
    places = F.when(F.length(name) >= size, F.sequence(F.lit(1), F.length(name) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substr(F.col(name), i, F.lit(size))))


def contained(names: DataFrame, key: str, name: str) -> DataFrame:
    """`a_id`, `b_id`, `a_same`, `b_same`: every two different names of which a's contains b's.

    Equal names are one class, which its least key stands for; `a_same` and
    `b_same` are the sizes of the classes. A contained name of three
    characters or more is looked up by that one of its three-character pieces
    that the fewest names have, a shorter one by itself among the pieces of
    its length; every hit is verified. No name and no piece is left out,
    however frequent. Null and empty names give no row.
    """
    one = names.where(F.length(name) > 0).groupBy(F.col(name).alias("name")).agg(F.min(key).alias("id"), F.count("*").alias("same"))
    listed = one.select("id", "name", "same", F.explode(F.concat(*[_pieces("name", n) for n in range(1, _PIECE + 1)])).alias("piece"))
    long_ = listed.where(F.length("piece") == _PIECE)
    uses = long_.groupBy("piece").agg(F.count("*").alias("uses"))
    rarest = long_.join(uses, "piece").groupBy("id", "name", "same").agg(F.min(F.struct("uses", "piece"))["piece"].alias("piece"))
    sought = rarest.unionByName(one.where(F.length("name") < _PIECE).withColumn("piece", F.col("name")))
    hits = listed.join(sought.select(F.col("id").alias("b_id"), F.col("name").alias("b"), F.col("same").alias("b_same"), "piece"), "piece")
    return hits.where((F.col("name") != F.col("b")) & F.contains("name", F.col("b"))).select(F.col("id").alias("a_id"), "b_id", F.col("same").alias("a_same"), "b_same")
