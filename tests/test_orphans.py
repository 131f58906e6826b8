"""Orphan references against brute force."""

import datetime as dt
import random

import pytest

from canonry.operators.orphans import orphan_cascade

T0 = dt.datetime(2020, 1, 1)
REFS = "ref_field string, record_id string, ref_pos int, ref_key string, ref_time timestamp_ntz, answered string, open string"
TARGETS = "key string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def brute(refs, targets, owners):
    def ok(k, t):
        return any(a == k and (f is None or (t is not None and f <= t)) and (u is None or (t is not None and u > t) or (f is None and u is None)) and not (f and u and u <= f) for a, f, u in targets)

    live = [r for r in refs if r[3] is not None]
    out = {r[:3]: ("direct", 0) for r in live if not ok(r[3], r[4])}
    broken = {r[1] for r in live if r[:3] in out}
    seen, depth = set(), 0
    keys = {k for i, k in owners if i in broken and k}
    while keys:
        depth += 1
        seen |= keys
        hit = [r for r in live if r[3] in keys and out.get(r[:3], ("", 0))[0] != "direct"]
        for r in hit:
            out.setdefault(r[:3], ("inherited", depth))
        keys = {k for i, k in owners if k and i in {r[1] for r in hit}} - seen
    return out


@pytest.mark.parametrize("max_rows", [3, 1000])
def test_against_brute_force(spark, max_rows):
    rng = random.Random(max_rows)
    day = lambda: T0 + dt.timedelta(days=rng.randint(0, 20))
    keys = ["hot", "hot", "k1", "k2", "k3", "k4", "gone"]
    refs = [("f", f"r{i}", 1, rng.choice([*keys, None]), rng.choice([day(), day(), day(), None])) for i in range(60)]
    targets = [(rng.choice(keys[:-1]), rng.choice([day(), day(), None]), rng.choice([None, day()])) for _ in range(12)]
    targets = [(k, f, u) if f else (k, None, None) for k, f, u in targets]
    owners = [(f"r{i}", rng.choice(["k1", "k2", "k3", None, f"own{i}"])) for i in range(60)]
    got = orphan_cascade(
        spark.createDataFrame([(*r, "x", "y") for r in refs], REFS), spark.createDataFrame(targets + targets[:3], TARGETS), spark.createDataFrame(owners, "record_id string, key string"), max_rows=max_rows
    ).collect()
    want = brute(refs, targets, owners)
    assert {(r.ref_field, r.record_id, r.ref_pos): r.orphan for r in got} == {k: v[0] for k, v in want.items()}
    assert {(r.ref_field, r.record_id, r.ref_pos): r.depth for r in got} == {k: v[1] for k, v in want.items()}
    assert len(got) == len(want)


def test_cycle_and_empty(spark):
    refs = spark.createDataFrame([("f", "a", 1, "B", T0, "", ""), ("f", "b", 1, "A", T0, "", ""), ("f", "a", 2, "none", T0, "", "")], REFS)
    targets = spark.createDataFrame([("A", T0, None), ("B", T0, None)], TARGETS)
    owners = spark.createDataFrame([("a", "A"), ("b", "B")], "record_id string, key string")
    assert sorted((r.record_id, r.ref_pos, r.orphan, r.depth) for r in orphan_cascade(refs, targets, owners).collect()) == [("a", 1, "inherited", 2), ("a", 2, "direct", 0), ("b", 1, "inherited", 1)]
    assert orphan_cascade(refs.limit(0), targets.limit(0), owners.limit(0)).count() == 0
