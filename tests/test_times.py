"""Timestamps against the standard library's zone rules."""

import datetime as dt
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from canonry.functions.times import utc_seconds, utc_text

UTC = dt.timezone.utc


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, zone string")
    return [r.t for r in df.select("i", utc_text(utc_seconds("raw", F.col("zone"))).alias("t")).orderBy("i").collect()]


def local(wall, zone):
    """First of two times; a skipped time has the offset from before."""
    z = zoneinfo.ZoneInfo(zone)
    return str(wall.replace(tzinfo=z, fold=0).astimezone(UTC).replace(tzinfo=None))


def test_zones_by_rule(spark):
    rng = random.Random(2)
    rows, want = [], []
    for zone in ("Europe/Paris", "America/New_York", "Asia/Ho_Chi_Minh"):
        for year in (2011, 2019, 2023):
            z = zoneinfo.ZoneInfo(zone)
            hours = [dt.datetime(year, 1, 1) + dt.timedelta(hours=h) for h in range(24 * 365)]
            turns = [a for a, b in zip(hours, hours[1:]) if a.replace(tzinfo=z).utcoffset() != b.replace(tzinfo=z).utcoffset()]
            for t in [*turns, *rng.sample(hours, 10)]:
                for minutes in range(-120, 150, 30):
                    wall = t + dt.timedelta(minutes=minutes, seconds=7)
                    rows.append((wall.strftime("%Y-%m-%dT%H:%M:%S"), zone))
                    rows.append((wall.strftime("%d/%m/%Y %H:%M:%S") + f" {zone}", None))
                    want += [local(wall, zone)] * 2
    assert run(spark, rows) == want


FORMS = [
    ("24/03/2019", None, "2019-03-23 17:00:00"), ("1/2/09", None, "2009-01-31 17:00:00"), ("20190324", "Europe/Paris", "2019-03-23 23:00:00"), ("1540688304", None, "2018-10-28 00:58:24"), ("1589354076999", None, "2020-05-13 07:14:36"),
    ("06 giờ 47, ngày 26/10/2008", None, "2008-10-25 23:47:00"), ("ngày 2 tháng 12 năm 2017", None, "2017-12-01 17:00:00"), ("12 Aug 2008", None, "2008-08-11 17:00:00"), ("Sun, 01 Oct 2017 02:47:16 +0700", None, "2017-09-30 19:47:16"),
    ("02/10/2011 12:00:00 AM", "Europe/Paris", "2011-10-01 22:00:00"), ("2011-03-27 03:24:21 CEST", None, "2011-03-27 01:24:21"), ("2017-03-12T04:16:21[America/New_York]", None, "2017-03-12 08:16:21"), ("2017-01-01 00:00:00.999999Z", None, "2017-01-01 00:00:00"),
    ("2024-10-27 03:50+01:00", None, "2024-10-27 02:50:00"), ("2008-02-05 17:00", "Nowhere/Land", "2008-02-05 10:00:00"), ("  2008-02-05   17:00 ", None, "2008-02-05 10:00:00"),
]


@pytest.mark.parametrize("raw, zone, want", FORMS)
def test_forms(spark, raw, zone, want):
    assert run(spark, [(raw, zone)]) == [want]


def test_no_time(spark):
    bad = ["31/02/2019", "2019-13-05", "0000-00-00", "30/02/2016 25:10", "chưa xác định", "N/A", "nan", "", " ", None, "2019-01-01 13:00 PM", "2019-01-01 10:00 Moon/Base", "2019-01-01 10:00 XYZ", "x" * 100_000, "99999999999999999999", "12:30"]
    assert run(spark, [(b, None) for b in bad]) == [None] * len(bad)


def test_session_zone_is_irrelevant(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert run(spark, [("2019-03-31T02:30:00", "Europe/Paris")]) == ["2019-03-31 01:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
