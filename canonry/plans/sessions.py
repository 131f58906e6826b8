"""Session state over messages, and event windows as extras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.operators import sessions as S
from canonry.operators.graph import latest
from canonry.operators.ordered import Ordered
from canonry.sources.tables import table
from canonry.streaming.windows import tumbling


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").where(F.col("session_id").isNotNull()).select("id", "session_id", F.lower(F.trim("role")).alias("role"), "content", "created_at").distinct()


_ORDER = ["id", "created_at", "role", "content"]


def history_window(spark: SparkSession, folder: str) -> DataFrame:
    """The last 14 messages of every session, oldest first."""
    return S.history_window(_messages(spark, folder), "session_id", _ORDER).select("session_id", "place", "id")


def drop_last_turn(spark: SparkSession, folder: str) -> DataFrame:
    """The same without the last two messages."""
    return S.history_window(_messages(spark, folder), "session_id", _ORDER, drop_last=2).select("session_id", "place", "id")


def first_user_message(spark: SparkSession, folder: str) -> DataFrame:
    """The title of a session: the first 40 characters of the first user message."""
    rows = S.first_of_role(_messages(spark, folder).where(F.col("content").isNotNull()), "session_id", "role", "user", _ORDER, "content")
    return rows.select("session_id", F.substring("content", 1, 40).alias("title"))


def list_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty sessions with the most messages among those with at least two."""
    return S.session_list(_messages(spark, folder), "session_id", "id").orderBy(F.desc("messages"), "session_id").limit(50)


def message_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Messages by role, with sessions and mean length."""
    rows = _messages(spark, folder).groupBy("role")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.round(F.avg(F.length("content")), 6).alias("mean_length"))


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of every user."""
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return latest(rows, ["user_id"], [F.col("ts"), F.col("event_id")])


def ext_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Extra: events by hour and type."""
    rows = tumbling(table(spark, folder, "events"), "ts", "1 hour", ["event_type"])
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def ext_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Extra: events in windows of six hours every three hours."""
    rows = table(spark, folder, "events").groupBy(F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "users")


def ext_session(spark: SparkSession, folder: str) -> DataFrame:
    """Extra: visits of users, ended by a gap of more than two hours."""
    rows = table(spark, folder, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ordered = Ordered(rows, ["user_id"], F.col("us"), [F.col("us"), F.col("event_id")]).lag("us", "before")
    ordered.df = ordered.df.withColumn("new", F.coalesce(F.col("us") - F.col("before") > 7_200_000_000, F.lit(True)).cast("long"))
    numbered = ordered.running_sum("new", "visit").rows()
    return numbered.groupBy("user_id", "visit").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


QUERIES = {f.__name__: f for f in (history_window, drop_last_turn, first_user_message, list_sessions, message_counts, latest_state, ext_tumbling, ext_sliding, ext_session)}

_M = "WITH m AS (SELECT DISTINCT id, session_id, lower(trim(role, ' ')) AS role, content, created_at FROM messages WHERE session_id IS NOT NULL)"
_B = "b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC NULLS LAST, created_at DESC NULLS LAST, role DESC NULLS LAST, content DESC NULLS LAST) AS back FROM m)"
SQL = {
    "history_window": f"{_M}, {_B} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY back DESC) AS INTEGER) AS place, id FROM b WHERE back <= 14",
    "drop_last_turn": f"{_M}, {_B} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY back DESC) AS INTEGER) AS place, id FROM b WHERE back <= 16 AND back > 2",
    "first_user_message": f"{_M} SELECT session_id, substr(arg_min(content, (id, created_at, role, content)), 1, 40) AS title FROM m WHERE role = 'user' AND content IS NOT NULL GROUP BY session_id",
    "list_sessions": f"{_M} SELECT session_id, count(*) AS messages, min(id) AS first_at, max(id) AS last_at FROM m GROUP BY session_id HAVING count(*) >= 2 ORDER BY messages DESC, session_id LIMIT 50",
    "message_counts": f"{_M} SELECT role, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(length(content)), 6) AS mean_length FROM m GROUP BY role",
    "latest_state": "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "ext_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ext_sliding": "SELECT w AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY w",
    "ext_session": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events), v AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM g)
      SELECT user_id, CAST(visit AS BIGINT) AS visit, count(*) AS n, min(ts) AS start, max(ts) AS "end" FROM v GROUP BY ALL""",
}
