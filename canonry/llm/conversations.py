"""Whole conversations from single message rows (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import BLANK
from canonry.operators.ordered import Ordered

#: How roles are written.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "system": "system"}


def bare(col: Column | str) -> Column:
    """Lower case without outer blanks; null if nothing remains."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")), F.lit(""))


def role_of(col: Column | str) -> Column:
    """`user`, `assistant`, `system`, or `other` for anything else and null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), bare(col)), F.lit("other"))


def instant_of(col: Column | str, zone: str = "+07:00") -> Column:
    """Microseconds since 1970 of an ISO text or of bare digits (milliseconds); a text without zone is in `zone`."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    zoned = text.rlike(iso + r" ?(Z|[+-]\d{2}:?\d{2})$")
    local = text.rlike(iso + "$")
    fixed = F.regexp_replace(text, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    full = F.when(zoned, fixed).when(local, F.concat(text, F.lit(zone)))
    return F.when(text.rlike(r"^\d{1,17}$"), text.try_cast("long") * 1000).otherwise(F.unix_micros(full.try_cast("timestamp")))


def fold_events(messages: DataFrame, session: str, role: str, content: str, created: str, message_id: str, op: str | None = None, target: str | None = None) -> DataFrame:
    """The event log folded to final messages: `session_id`, `role`, `at`, `message_id`, `content`.

    Each row is an event. Without `op` all are creations, and rows alike in
    session, role, content and instant are retries of one message, which
    keeps the lowest id. With `op` (`create`, `edit`, `delete`, `retry`) and
    `target` (the id that is edited, deleted or tried again; null means the
    row's own id) the events of one target are versions in the order of
    instant, then id: the last decides, a `delete` removes the message, an
    `edit` or `retry` replaces its content and keeps its place. Rows with a
    null session or blank content (deletes aside) are ignored. Both folds
    are aggregates with a partial step, so no group is gathered.
    """
    kind = F.lower(F.trim(F.coalesce(F.col(op), F.lit("create")))) if op else F.lit("create")
    rows = messages.select(
        bare(session).alias("session_id"), role_of(role).alias("role"), F.col(content).alias("content"), instant_of(created).alias("at"), F.col(message_id).alias("message_id"),
        kind.alias("__op"), (F.coalesce(F.col(target), F.col(message_id)) if target else F.col(message_id)).alias("__target"),
    )
    rows = rows.where(F.col("session_id").isNotNull() & ((F.col("__op") == "delete") | bare("content").isNotNull()))
    if op:
        version = F.struct("at", "message_id")
        rows = rows.groupBy("session_id", F.col("__target").alias("message_id")).agg(
            F.max_by("__op", version).alias("__op"), F.max_by("content", version).alias("content"), F.min_by("role", version).alias("role"), F.min("at").alias("at")
        )
        rows = rows.where(F.col("__op") != "delete")
    alike = rows.groupBy("session_id", "role", "at", F.sha2("content", 256).alias("__same"))
    return alike.agg(F.min("message_id").alias("message_id"), F.first("content").alias("content")).drop("__same")


def conversations(turns: DataFrame, sessions: DataFrame, listed: str, max_rows: int = 2_000_000, counted: DataFrame | None = None) -> DataFrame:
    """The messages of whole conversations: `session_id`, `turn` from 1, `message_id`, `role`, `content`.

    `turns` is what `fold_events` gives. Order is by instant, then id. Kept
    are sessions in `sessions.listed` (regardless of case and outer blanks)
    with any number of system messages first and then user and assistant
    in strict turn, beginning with a user, ending with the assistant. Any
    other role, and a message without readable time, breaks a conversation.
    A session that holds a large share of all rows is ordered in blocks, also
    within one instant. `counted` is a cheaper frame to count sessions by:
    `session_id` as in `turns`, with at least as many rows each.
    """
    order = [F.col("at"), F.col("message_id"), F.col("role")]
    ordered = Ordered(turns, ["session_id"], F.col("at"), order, max_rows, counted=counted, within=F.col("message_id"))
    rows = ordered.row_number("turn").lag("role", "__before").rows()
    role, before = F.col("role"), F.col("__before")
    good = (
        F.when(F.col("at").isNull(), False)
        .when(role == "system", F.coalesce(before == "system", F.lit(True)))
        .when(role == "user", F.coalesce(before != "user", F.lit(True)))
        .when(role == "assistant", F.coalesce(before == "user", F.lit(False)))
        .otherwise(False)
    )
    checked = rows.withColumn("__good", good)
    whole = checked.groupBy("session_id").agg(F.bool_and("__good").alias("ok"), F.max_by("role", "turn").alias("last"))
    known = sessions.select(bare(listed).alias("session_id")).where(F.col("session_id").isNotNull()).distinct()
    kept = whole.where(F.col("ok") & (F.col("last") == "assistant")).select("session_id").join(known, "session_id", "left_semi")
    return rows.join(kept, "session_id", "left_semi").select("session_id", F.col("turn").cast("int").alias("turn"), "message_id", "role", "content")
