"""Conversation rows as history windows and latest state, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def history_window(messages: DataFrame, session: str, order: list[str], size: int = 14, drop_last: int = 0) -> DataFrame:
    """The last `size` messages of every session, `place` from the oldest, without the very last `drop_last`.

    The rank limit is applied in every task before the shuffle, so a long
    session sends at most `size` + `drop_last` rows per task.
    """
    back = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    ranked = messages.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= size + drop_last).where(F.col("__back") > drop_last)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("__back")))).drop("__back")


def first_of_role(messages: DataFrame, session: str, role: str, wanted: str, order: list[str], value: str) -> DataFrame:
    """The first value of one role in every session."""
    return messages.where(F.col(role) == wanted).groupBy(session).agg(F.min_by(value, F.struct(*order)).alias(value))


def session_list(messages: DataFrame, session: str, at: str, least: int = 2) -> DataFrame:
    """Sessions with at least `least` messages: count, first and last time."""
    return messages.groupBy(session).agg(F.count("*").alias("messages"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).where(F.col("messages") >= least)


def create_sessions(sessions: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`sessions` with those of `new` whose key isn't there yet; one of several new rows with the same key, the lowest, counts."""
    columns = [c for c in sessions.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, "r.*").select(*sessions.columns)
    return sessions.unionByName(first.join(sessions.select(key), key, "left_anti").select(*sessions.columns))


def rename_session(sessions: DataFrame, which: str, title: str, key: str = "id") -> DataFrame:
    """`sessions` with a new title for one."""
    return sessions.withColumn("title", F.when(F.col(key) == which, F.lit(title)).otherwise(F.col("title")))


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame, key: str = "id", session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions whose keys are in `gone`; messages without a session stay."""
    keys = gone.select(key).distinct()
    return sessions.join(keys, key, "left_anti"), messages.join(keys.withColumnRenamed(key, session), session, "left_anti").select(*messages.columns)
