"""Attribute history against a plain fold of each key's rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from canonry.operators.history import attribute_history, day_value, status_value

SCHEMA = "doc_id string, observed_at timestamp_ntz, loaded_at timestamp_ntz, op string, st string, ok boolean, snap_id long, valid_from string, __key string, change string"
T0 = dt.datetime(2020, 1, 1)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    out = attribute_history(df, "doc_id", "observed_at", "loaded_at", "op", {"st": F.col("st"), "ok": F.col("ok")}, tie="snap_id", **more)
    return sorted((r.doc_id, r.valid_from, r.valid_to, r.st, r.ok, r.change) for r in out.collect())


def expected(rows):
    last = {}
    for k, t, l, op, st, ok, i in rows:
        if k is None or t is None:
            continue
        rank = (l is not None, l or T0, i)
        if (k, t) not in last or rank > last[k, t][0]:
            last[k, t] = (rank, op, st, ok)
    out = []
    for key in {k for k, _ in last}:
        value, open_, state = [None, None], None, None
        for t in sorted(t for k, t in last if k == key):
            _, op, st, ok = last[key, t]
            value = [st if st is not None else value[0], ok if ok is not None else value[1]]
            if op == "delete":
                if open_:
                    out.append((key, open_, t, *state[:2], state[2]))
                open_ = None
            elif open_ is None or state[:2] != tuple(value):
                change = "inserted" if open_ is None else "changed"
                if open_:
                    out.append((key, open_, t, *state[:2], state[2]))
                open_, state = t, (*value, change)
        if open_:
            out.append((key, open_, None, *state[:2], state[2]))
    return sorted(out, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("max_rows", [4, 1000])
def test_against_fold(spark, max_rows):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        t = T0 + dt.timedelta(hours=rng.randint(0, 60))
        rows.append((rng.choice(["hot", "hot", "b", "c", None]), rng.choice([t, t, t, None]), t + dt.timedelta(minutes=i), rng.choice(["upsert"] * 5 + ["delete"]), rng.choice([None, "A", "B"]), rng.choice([None, True, False]), i))
    rows += rows[:20]
    assert run(spark, rows, max_rows=max_rows) == expected(rows)


def test_edges(spark):
    assert run(spark, []) == []
    t1, t2 = T0, T0 + dt.timedelta(days=1)
    assert run(spark, [("a", t1, t1, "delete", None, None, 1)]) == []
    assert run(spark, [("a", t1, None, None, "A" * 100_000, None, None)])[0][5] == "inserted"
    again = run(spark, [("a", t1, t1, "upsert", "A", True, 1), ("a", t2, t2, "DELETE ", None, None, 2), ("a", t2 + dt.timedelta(1), t2, "upsert", "A", True, 3)])
    assert [(r[1], r[2], r[5]) for r in again] == [(t1, t2, "inserted"), (t2 + dt.timedelta(1), None, "inserted")]


def test_values(spark):
    rows = [("  Đang  có HIỆU lực ", "01/02/2019"), ("Dang co hieu luc", "2019-02-01 00:00:00"), ("Đang có hiệu lực", "2019-02-01"), ("N/A", ""), (None, None)]
    got = spark.createDataFrame(rows, "s string, d string").select(status_value("s"), day_value("d")).collect()
    assert {tuple(r) for r in got[:3]} == {("dang co hieu luc", "2019-02-01")}
    assert [tuple(r) for r in got[3:]] == [(None, None)] * 2
