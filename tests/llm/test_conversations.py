"""Conversations against a plain reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from canonry.llm.conversations import conversations, fold_events, instant_of

MESSAGES = "id long, session_id string, role string, content string, created_at string, turn int"


def run(spark, rows, sessions=("s", "t", "u"), **more):
    df = spark.createDataFrame([(*r, 0) for r in rows], MESSAGES)
    turns = fold_events(df, "session_id", "role", "content", "created_at", "id")
    listed = spark.createDataFrame([(s, "x") for s in sessions], "id string, role string")
    return sorted((r.session_id, r.turn, r.message_id) for r in conversations(turns, listed, "id", **more).collect())


def at(n):
    return f"2024-01-01T00:{n:02d}:00Z"


def test_forms_of_one_message(spark):
    rows = [(5, " S ", "User", "a", "2024-01-01T07:00:00"), (3, "s", "human", "a", "2024-01-01T00:00:00Z"), (9, "s", "user ", "a", "1704067200000"), (4, "s", "AI", "b", "2024-01-01 07:01:00+07:00"), (1, "s", "system", "hi", "2023-12-31T00:00:00")]
    assert run(spark, rows) == [("s", 1, 1), ("s", 2, 3), ("s", 3, 4)]


@pytest.mark.parametrize("rows", [
    [], [(1, "s", "user", "a", at(0))], [(1, "s", "assistant", "a", at(0)), (2, "s", "user", "b", at(1)), (3, "s", "assistant", "c", at(2))], [(1, "s", "user", "a", at(0)), (2, "s", "user", "b", at(1)), (3, "s", "assistant", "c", at(2))],
    [(1, "s", "user", "a", at(0)), (2, "s", "system", "b", at(1)), (3, "s", "assistant", "c", at(2))], [(1, "s", "user", "a", at(0)), (2, "s", "tool", "b", at(1)), (3, "s", "assistant", "c", at(2))], [(1, "s", "system", "a", at(0))],
    [(1, "x", "user", "a", at(0)), (2, "x", "assistant", "b", at(1))], [(1, None, "user", "a", at(0)), (2, None, "assistant", "b", at(1))], [(1, "s", "user", "a", "?"), (2, "s", "assistant", "b", at(1))], [(1, "s", None, "a", at(0)), (2, "s", "assistant", "b", at(1))],
])
def test_dropped(spark, rows):
    assert run(spark, rows) == []


@pytest.mark.parametrize("max_rows", [4, 1000])
def test_against_rules(spark, max_rows):
    rng = random.Random(7)
    rows = []
    for s in ("s", "t", "u", "v"):
        for i in range(12):
            rows.append((rng.randint(1, 400), s, ["user", "assistant"][i % 2] if rng.random() < 0.97 else "user", rng.choice(["a" * 20_000, "b", "ć"]), at(i if rng.random() < 0.9 else i - 1)))
        rows += [(900, s, "user", "  ", at(3)), rows[-1], (901, s, "assistant", None, at(4))]
    want = []
    for s in ("s", "t", "u"):
        best = {}
        for i, sid, role, content, t in rows:
            if sid == s and content and content.strip():
                best[role, content, t] = min(i, best.get((role, content, t), i))
        order = sorted((t, i, role) for (role, _, t), i in best.items())
        roles = [r for _, _, r in order]
        if roles and roles == ["user", "assistant"] * (len(roles) // 2):
            want += [(s, n, i) for n, (_, i, _) in enumerate(order, 1)]
    assert run(spark, rows, max_rows=max_rows) == sorted(want)


def test_edits_and_deletes(spark):
    events = [(1, "s", "user", "q", at(0), "create", None), (2, "s", "assistant", "old", at(1), "create", None), (3, "s", "assistant", "new", at(5), "edit", 2), (4, "s", "user", "oops", at(2), "create", None), (5, "s", "user", None, at(3), "delete", 4), (6, "s", "assistant", "newer", at(6), "retry", 2)]
    df = spark.createDataFrame(events, "id long, session_id string, role string, content string, created_at string, op string, target long")
    turns = fold_events(df, "session_id", "role", "content", "created_at", "id", "op", "target")
    out = conversations(turns, spark.createDataFrame([("S ",)], "id string"), "id").orderBy("turn").collect()
    assert [(r.message_id, r.content) for r in out] == [(1, "q"), (2, "newer")]


def test_instants(spark):
    raws = ["2024-01-01T00:00:00", "2024-01-01 00:00:00.5+07:00", "2024-01-01T00:00:00Z", "1704067200000", "2024-13-01T00:00:00", "x", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, t string").orderBy("i").select(instant_of(F.col("t"))).collect()]
    utc = 1704067200 * 10**6
    assert got == [utc - 7 * 3600 * 10**6, utc - 7 * 3600 * 10**6 + 500_000, utc, utc, None, None, None, None]
