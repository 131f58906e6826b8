"""Order-dependent columns of keyed rows when one key may hold a large share of all rows.

A window over a hot key is one task's work. `Ordered` finds the keys with
more than `max_rows` rows, cuts each into blocks along its order at
approximate quantiles, runs every window per (key, block) and adds what
earlier or later blocks contribute, which is one small row a block. The
result equals the plain window's, whatever the cuts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "__block"
#: An instant that takes this share of a hot key's quantiles is cut by the second order column, into so many blocks.
_SHARE, _INNER = 64, 32


class Ordered:
    """Rows of `df` in the order of `order` within `key`.

    `time` is the leading order column, or an expression of one that rises with it;
    `order` must give a total order within the key, or as much of one as the
    windows need. `within` is a number that rises with `order` among rows of
    one time; with it an instant that holds many rows of a hot key, as a bulk
    load leaves, is cut too.

    Counting the keys is one eager job. `counted` gives it the keys of a
    frame that has at least the rows of `df` for each key and is cheaper to
    read (the raw table's key column); else `df` is read for it. The
    `most_hot` largest keys over `max_rows` are cut, into up to `cuts`
    blocks; any other key has at most `max_rows` rows or less than 1 /
    `most_hot` of all. What is broadcast has at most `most_hot` x `cuts` numbers.
    """

    def __init__(
        self, df: DataFrame, key: list[str], time: Column, order: list[Column], max_rows: int = 2_000_000, cuts: int = 2_048, most_hot: int = 2_000,
        counted: DataFrame | None = None, within: Column | None = None,
    ):
        self.key, self.order = key, order
        counts = (df if counted is None else counted).groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > max_rows)
        hot = counts.orderBy(F.desc("__n"), *key).limit(most_hot).collect()
        self.split = bool(hot)
        if not self.split:
            self.df = df.withColumn(BLOCK, F.lit(0).cast("long"))
            return
        cuts = min(cuts, max(16, 4 * hot[0]["__n"] // max_rows))
        at = df.withColumn("__at", F.coalesce(time.cast("double"), F.lit(-1e308)))
        keys = df.sparkSession.createDataFrame([r[:-1] for r in hot], df.select(*key).schema)
        renamed = [F.col(k).alias(f"__{k}") for k in key]
        bounds = at.join(F.broadcast(keys.select(*renamed)), self._same(df, key), "left_semi").groupBy(*key).agg(self._quantiles("__at", cuts).alias("__cuts"))
        if within is not None:
            at = at.withColumn("__within", within.cast("double"))
            often = F.filter(F.array_distinct("__cuts"), lambda c: F.size(F.filter("__cuts", lambda x: x == c)) * _SHARE >= cuts)
            crowded = bounds.select(*renamed, F.explode(often).alias("__instant"))
            inside = at.join(F.broadcast(crowded), self._same(df, key) & (at["__at"] == F.col("__instant"))).groupBy(*key, "__instant").agg(self._quantiles("__within", _INNER).alias("__sub"))
            bounds = bounds.join(inside.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__instant", "__sub"))).alias("__subs")), key, "left")
        rows = at.join(F.broadcast(bounds.select(*renamed, *[c for c in bounds.columns if c not in key])), self._same(df, key), "left")
        place = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col("__at"))).cast("long") * (_INNER + 1)
        if within is not None:
            sub = F.try_element_at(F.col("__subs"), F.col("__at"))
            place = place + F.coalesce(F.when(sub.isNotNull(), 1 + F.size(F.filter(sub, lambda c: c < F.col("__within")))), F.lit(0))
        self.df = rows.withColumn(BLOCK, place).select(*df.columns, BLOCK)

    @staticmethod
    def _quantiles(name: str, parts: int) -> Column:
        return F.percentile_approx(name, [i / parts for i in range(1, parts)], 10_000)

    @classmethod
    def over(cls, df: DataFrame, key: list[str], order: list[Column], split: bool) -> "Ordered":
        """Windows over rows that already carry the blocks of another `Ordered`."""
        self = cls.__new__(cls)
        self.df, self.key, self.order, self.split = df, key, order, split
        return self

    @staticmethod
    def _same(df: DataFrame, key: list[str]) -> Column:
        same = F.lit(True)
        for k in key:
            same = same & df[k].eqNullSafe(F.col(f"__{k}"))
        return same

    def _window(self):
        return Window.partitionBy(*self.key, BLOCK).orderBy(*self.order)

    def _blocks(self, aggregates: list[Column], derive: dict[str, Column]) -> DataFrame:
        """One row a block with what it takes from the others."""
        per = self.df.groupBy(*self.key, BLOCK).agg(*aggregates)
        return per.select(*[F.col(c).alias(f"__{c}") for c in [*self.key, BLOCK]], *[e.alias(n) for n, e in derive.items()])

    def _attach(self, blocks: DataFrame) -> DataFrame:
        return self.df.join(blocks, self._same(self.df, [*self.key, BLOCK]), "left").drop(*[f"__{c}" for c in [*self.key, BLOCK]])

    def _over(self):
        return Window.partitionBy(*self.key).orderBy(BLOCK)

    def row_number(self, name: str) -> "Ordered":
        """Adds the place in the key, from 1."""
        self.df = self.df.withColumn(name, F.row_number().over(self._window()))
        if self.split:
            before = self._over().rowsBetween(Window.unboundedPreceding, -1)
            blocks = self._blocks([F.count("*").alias("__n")], {"__base": F.coalesce(F.sum("__n").over(before), F.lit(0))})
            self.df = self._attach(blocks).withColumn(name, (F.col(name) + F.col("__base")).cast("long")).drop("__base")
        return self

    def running_sum(self, source: str, name: str) -> "Ordered":
        """Adds the sum of `source` up to the row."""
        rows = self._window().rowsBetween(Window.unboundedPreceding, 0)
        self.df = self.df.withColumn(name, F.sum(source).over(rows))
        if self.split:
            before = self._over().rowsBetween(Window.unboundedPreceding, -1)
            blocks = self._blocks([F.sum(source).alias("__n")], {"__base": F.coalesce(F.sum("__n").over(before), F.lit(0))})
            self.df = self._attach(blocks).withColumn(name, F.col(name) + F.col("__base")).drop("__base")
        return self

    def fill_forward(self, columns: list[str]) -> "Ordered":
        """Replaces nulls by the last value before them."""
        rows = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if self.split:
            place = F.struct(*self.order_values())
            before = self._over().rowsBetween(Window.unboundedPreceding, -1)
            blocks = self._blocks(
                [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__l_{c}") for c in columns],
                {f"__c_{c}": F.last(f"__l_{c}", ignorenulls=True).over(before) for c in columns},
            )
            self.df = self._attach(blocks)
        filled = {c: F.last(c, ignorenulls=True).over(rows) for c in columns}
        if self.split:
            filled = {c: F.coalesce(e, F.col(f"__c_{c}")) for c, e in filled.items()}
        self.df = self.df.withColumns(filled).drop(*[f"__c_{c}" for c in columns])
        return self

    def order_values(self) -> list[Column]:
        """The order columns as plain values, for comparisons of whole rows."""
        return [F.col(c) if isinstance(c, str) else c for c in self.order]

    def _near(self, source: str, name: str, ahead: bool) -> "Ordered":
        local = (F.lead(source) if ahead else F.lag(source)).over(self._window())
        edge = (F.lead(F.lit(1)) if ahead else F.lag(F.lit(1))).over(self._window())
        if not self.split:
            self.df = self.df.withColumn(name, local)
            return self
        self.df = self.df.withColumns({name: local, "__inner": edge})
        pick = (F.min_by if ahead else F.max_by)(F.struct(source), F.struct(*self.order_values()))
        value = (F.lead("__v") if ahead else F.lag("__v")).over(self._over())
        blocks = self._blocks([pick.alias("__v")], {"__other": value})
        joined = self._attach(blocks)
        self.df = joined.withColumn(name, F.when(F.col("__inner").isNotNull(), F.col(name)).otherwise(F.col("__other")[source])).drop("__inner", "__other")
        return self

    def lead(self, source: str, name: str) -> "Ordered":
        """Adds the next row's `source`."""
        return self._near(source, name, True)

    def lag(self, source: str, name: str) -> "Ordered":
        """Adds the row before's `source`."""
        return self._near(source, name, False)

    def rows(self) -> DataFrame:
        """The rows with all columns added so far."""
        return self.df.drop(BLOCK)
