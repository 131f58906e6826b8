"""Rolling conversation history, expiring uploads and upserted state as streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_history(messages: DataFrame, size: int = 14, ttl_ms: int = 86_400_000, delay: str = "1 hour") -> DataFrame:
    """The last `size` messages of a session after every batch that brings some; state of silent sessions expires.

    `messages` has `session_id`, `id`, `ts` and `content`. State holds at
    most `size` rows a session, whatever its length, and expires in event
    time, `ttl_ms` after the session's last message.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += list(zip(batch["id"].tolist(), batch["ts"].astype("datetime64[ns]").astype("int64").tolist(), batch["content"].tolist()))
            held = sorted(dict.fromkeys(held), key=lambda r: (r[1], r[0]))[-size:]
        state.update(tuple(map(list, zip(*held))))
        state.setTimeoutTimestamp(max(held[-1][1] // 1_000_000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": key[0], "place": range(1, len(held) + 1), "id": [r[0] for r in held], "content": [r[2] for r in held]})

    return messages.withWatermark("ts", delay).groupBy("session_id").applyInPandasWithState(
        update, "session_id string, place int, id long, content string", "ids array<long>, times array<long>, contents array<string>", "update", GroupStateTimeout.EventTimeTimeout
    )


def live_uploads(uploads: DataFrame, at: str, now, ttl_seconds: int = 300) -> DataFrame:
    """Uploads of a session that haven't expired, only of its latest document (batch form)."""
    fresh = uploads.where(F.unix_timestamp(F.lit(now)) - F.unix_timestamp(at) < ttl_seconds)
    newest = fresh.groupBy("session_id").agg(F.max_by("document_id", F.struct(at, "document_id")).alias("document_id"))
    return fresh.join(newest, ["session_id", "document_id"], "left_semi")


def tumbling(events: DataFrame, at: str, size: str, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Counts and sums per window; the same function for a stream and for a table."""
    source = events.withWatermark(at, watermark) if events.isStreaming else events
    return source.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _folded(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("r")).select(key, "r.*")


def _versions(spark: SparkSession, target: str, number: int | None = None) -> tuple[list[int], list[int]]:
    """Numbers of the complete bases, before `number` if given, and of the complete batches after the last of them, up to `number`."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in (fs.listStatus(path) if fs.exists(path) else []) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    found = {kind: sorted(int(n.removeprefix(kind)) for n in names if n.startswith(kind)) for kind in ("base_", "batch_")}
    bases = [b for b in found["base_"] if number is None or b < number]
    return bases, [b for b in found["batch_"] if (not bases or b > bases[-1]) and (number is None or b <= number)]


def upserted(spark: SparkSession, target: str, key: str, order: str, number: int | None = None) -> DataFrame | None:
    """The latest row of each key of a folder that `upsert_batches` writes, up to the batch `number`; None while it is empty."""
    bases, batches = _versions(spark, target, number)
    paths = [f"{target}/base_{bases[-1]}"] if bases else []
    paths += [f"{target}/batch_{b}" for b in batches]
    return _folded(reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths]), key, order) if paths else None


def upsert_batches(target: str, key: str, order: str, compact_every: int = 20):
    """A `foreachBatch` function that keeps the latest row of each key in a folder; `upserted` reads it.

    A batch writes only its own rows, so its cost doesn't grow with the
    state; every `compact_every` batches they are folded into a new base and
    what is older than the base before is removed. Batches and bases are
    written whole, and a batch that is tried again replaces itself, so a lost
    executor or driver leaves a readable state.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _folded(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch_{number}")
        if (number + 1) % compact_every:
            return
        bases, _ = _versions(spark, target, number)
        upserted(spark, target, key, order, number).write.mode("overwrite").parquet(f"{target}/base_{number}")
        # readers that began before may still use the last base and what came after it
        hadoop = spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        last = bases[-1] if bases else -1
        for status in fs.listStatus(hadoop.Path(target)):
            kind, _, n = status.getPath().getName().partition("_")
            if (kind == "base" and int(n) < last) or (kind == "batch" and int(n) <= last):
                fs.delete(status.getPath(), True)

    return write
