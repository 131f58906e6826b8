"""References to records that do not exist, directly or through their ancestors (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.operators.ordered import Ordered
from canonry.session import written


REFERENCE = ("ref_field", "record_id", "ref_pos", "ref_key", "ref_time")


def mark_answered(refs: DataFrame, targets: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """The `REFERENCE` columns of the rows of `refs` that have a key, with `answered`: whether a row of `targets` answers.

    A target (`key`, `valid_from`, `valid_to`) answers a reference with its
    key if `valid_from` <= `ref_time` and `valid_to` is null or later; a null
    `valid_from` means always. Starts, ends and references of a key are swept
    in the order of time with a running count of valid targets, so the work
    is n log n whatever the number of targets or references of a key, and
    hot keys are swept in blocks. A reference without time is answered only
    by targets that are valid always; one without key is no reference.
    """
    start = F.coalesce(F.unix_micros(F.col("valid_from").cast("timestamp")), F.lit(-(2**62)))
    end = F.unix_micros(F.col("valid_to").cast("timestamp"))
    spans = targets.where(F.col("key").isNotNull()).select("key", start.alias("a"), end.alias("b")).where(F.col("b").isNull() | (F.col("b") > F.col("a")))
    steps = spans.select("key", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("d")), F.struct(F.col("b").alias("t"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.where(F.col("s.t").isNotNull()).groupBy("key", F.col("s.t").alias("t")).agg(F.sum("s.d").cast("long").alias("d"))
    # written first, as the keys are counted before they are swept
    refs, _ = written(refs.select(*REFERENCE).where(F.col("ref_key").isNotNull()))
    asked = refs
    payload = F.struct(*[asked[c] for c in asked.columns])
    asked = asked.select(F.col("ref_key").alias("key"), F.coalesce(F.unix_micros(F.col("ref_time").cast("timestamp")), F.lit(-(2**62) + 1)).alias("t"), F.lit(0).cast("long").alias("d"), payload.alias("ref"))
    nothing = F.lit(None).cast(asked.schema["ref"].dataType)
    # at one instant starts and ends come first; references are spread by a hash, so that a crowded instant can be cut too
    place = F.when(F.col("ref").isNull(), F.lit(-1).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64("ref.ref_field", "ref.record_id", "ref.ref_pos"), 1))
    swept = steps.withColumn("ref", nothing).unionByName(asked).withColumn("place", place)
    many = refs.select(F.col("ref_key").alias("key")).unionByName(spans.select("key"))
    ordered = Ordered(swept, ["key"], F.col("t"), [F.col("t"), F.col("place")], max_rows, counted=many, within=F.col("place"))
    open_ = ordered.running_sum("d", "open").rows()
    return open_.where(F.col("ref").isNotNull()).select("ref.*", (F.col("open") > 0).alias("answered"))


def orphan_cascade(refs: DataFrame, targets: DataFrame, owners: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """Direct and inherited orphans among `refs`, with `orphan` (`direct`, `inherited`) and `depth`.

    `refs` has `ref_field`, `record_id`, `ref_pos`, `ref_key`, `ref_time`;
    `owners` (`record_id`, `key`) tells under which key a referring record
    can itself be referred to. A reference without a valid target is a direct
    orphan (depth 0). A record with an orphan reference is broken; references
    to its key that do have a target are inherited orphans, one deeper, and
    break their own record.

    The cascade runs on the distinct graph of keys (cited key, citing
    record's key), which is made once. The frontier of newly broken keys is
    semi-joined with it until nothing is new, whatever the depth; cycles end
    because a key breaks once. The references meet the depths of their keys
    in one join at the end. What a round finds is written to the shared
    folder. Empty tables give an empty result.
    """
    marked, _ = written(mark_answered(refs, targets, max_rows))
    owned = owners.where(F.col("key").isNotNull()).select("record_id", "key").distinct()
    cited = marked.join(owned, "record_id").select(F.col("ref_key").alias("cited"), "key", "answered").distinct()
    graph, _ = written(cited)
    edges = graph.where("answered").select("cited", "key")
    frontier, new = written(graph.where(~F.col("answered")).select("key").distinct().withColumn("depth", F.lit(1)))
    broken, levels, depth = frontier, 1, 1
    while new:
        depth += 1
        hit = edges.join(frontier.select(F.col("key").alias("cited")), "cited", "left_semi").select("key").distinct()
        frontier, new = written(hit.join(broken.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)))
        broken, levels = broken.unionByName(frontier), levels + 1
        if levels == 16:
            # a plan over many small tables grows; one table replaces them
            (broken, _), levels = written(broken), 1
    direct = marked.where(~F.col("answered")).select(*REFERENCE, F.lit("direct").alias("orphan"), F.lit(0).alias("depth"))
    inherited = marked.where("answered").join(broken.select(F.col("key").alias("ref_key"), "depth"), "ref_key")
    return direct.unionByName(inherited.select(*REFERENCE, F.lit("inherited").alias("orphan"), "depth"))
