"""Validity periods of entity attributes from periodic snapshots (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import fold, known, squeeze
from canonry.operators.ordered import BLOCK, Ordered

#: What the crawler writes for an unknown value.
UNKNOWN = ("N/A",)


def status_value(col: Column | str) -> Column:
    """A status that is equal regardless of case, accents, Unicode form and extra blanks; null if unknown."""
    return fold(squeeze(known(col, *UNKNOWN)))


def day_value(col: Column | str) -> Column:
    """`YYYY-MM-DD` of an ISO, year-first or day-first date with or without a time; null if unknown.

    A text that is no such date counts as a value of its own, in folded form.
    """
    bare = squeeze(known(col, *UNKNOWN))
    tail = r"(?:[T ].*)?$"
    year_first, packed, day_first = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + tail, r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + tail

    def pick(pattern: str, order: tuple[int, int, int]) -> Column:
        part = [F.regexp_extract(bare, pattern, g) for g in order]
        return F.when(bare.rlike(pattern), F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))

    return F.coalesce(pick(year_first, (1, 2, 3)), pick(packed, (1, 2, 3)), pick(day_first, (3, 2, 1)), fold(bare))


def attribute_history(
    snapshots: DataFrame,
    key: str,
    observed: str,
    loaded: str,
    op: str,
    attributes: dict[str, Column],
    tie: str | None = None,
    max_rows: int = 2_000_000,
) -> DataFrame:
    """Every version of every entity: `key`, the attributes, `change`, `valid_from`, `valid_to`.

    Among rows of one key and `observed` only the last by `loaded` (then by
    `tie`, then by the row's values) counts. Null attributes are unknown and
    keep the last known value, also across a delete. The states a key has in
    consecutive snapshots are compared by a null-safe full outer join of the
    live states numbered k with those numbered k - 1: a state on the right
    alone is `inserted`, on both sides but different `changed`, on the left
    alone deleted at the time of snapshot k. The events are united and
    `lead` gives the end of each version; null means still valid.

    Rows with a null key or a null `observed` are ignored. Any `op` but
    `delete` (regardless of case and blanks) is an upsert. An empty table
    gives an empty result; extra columns are ignored. The join key has the
    snapshot's number, so a hot key spreads over all tasks; its windows run
    in blocks (see `Ordered`).
    """
    names = list(attributes)
    inner = [f"__a{i}" for i in range(len(names))]
    tied = F.col(tie) if tie else F.lit(None).cast("string")
    rows = snapshots.where(F.col(key).isNotNull() & F.col(observed).isNotNull()).select(
        F.col(key).alias("__key"), F.col(observed).alias("__t"), F.col(loaded).alias("__loaded"), tied.alias("__tie"),
        (F.lower(F.trim(F.coalesce(F.col(op), F.lit("upsert")))) == "delete").alias("__gone"), *[e.alias(i) for i, e in zip(inner, attributes.values())],
    )
    state = F.struct("__gone", *inner)
    last = rows.groupBy("__key", "__t").agg(F.max_by(state, F.struct("__loaded", "__tie", state)).alias("__s"))
    last = last.select("__key", "__t", "__s.*")
    ordered = Ordered(last, ["__key"], F.unix_micros(F.col("__t").cast("timestamp")), [F.col("__t")], max_rows, counted=snapshots.select(F.col(key).alias("__key")))
    ordered.fill_forward(inner).row_number("__seq")
    ordered.df = ordered.df.withColumn("__at", F.struct("__t", BLOCK))
    ordered.lead("__at", "__next")
    live = ordered.df.where(~F.col("__gone"))

    new = live.select(F.col("__key").alias("nk"), F.col("__seq").alias("ns"), F.col("__at").alias("n_at"), F.struct(*inner).alias("n"))
    old = live.select(F.col("__key").alias("ok"), (F.col("__seq") + 1).alias("os"), F.col("__next").alias("o_next"), F.struct(*inner).alias("o"))
    both = new.join(old, F.col("nk").eqNullSafe(F.col("ok")) & F.col("ns").eqNullSafe(F.col("os")), "full_outer")
    kind = (
        F.when(F.col("ns").isNull() & F.col("o_next").isNotNull(), "deleted")
        .when(F.col("ns").isNotNull() & F.col("os").isNull(), "inserted")
        .when(F.col("ns").isNotNull() & ~F.col("n").eqNullSafe(F.col("o")), "changed")
    )
    classified = both.withColumn("change", kind).where(F.col("change").isNotNull())
    at = F.coalesce("n_at", "o_next")
    events = classified.select(F.coalesce("nk", "ok").alias("__key"), at["__t"].alias("__t"), at[BLOCK].alias(BLOCK), "change", "n")

    ending = Ordered.over(events, ["__key"], [F.col("__t")], ordered.split)
    ended = ending.lead("__t", "__end").rows().where(F.col("change") != "deleted")
    return ended.select(F.col("__key").alias(key), *[F.col("n")[i].alias(n) for i, n in zip(inner, names)], "change", F.col("__t").alias("valid_from"), F.col("__end").alias("valid_to"))
