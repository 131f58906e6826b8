"""Mixed timestamp texts to one unambiguous UTC time (problem 4)."""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from canonry.functions.text import fold, known, squeeze

#: Zone abbreviations and their offsets from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ict": 420, "wib": 420, "hkt": 480, "sgt": 480, "jst": 540, "kst": 540,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: English month names.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
#: Texts that hold no time.
UNKNOWN = ("N/A", "nan", "none", "null", "chưa xác định", "unknown")

_DATE_YMD = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_DATE_DMY = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?:\s?\[?([a-z]+(?:[/_+-][a-z0-9_+-]+)*|[+-]\d{2}(?::?\d{2})?)\]?)?"
_MONTH = "(" + "|".join(MONTHS) + ")[a-z]*"

PARTS = ("year", "month", "day", "hour", "minute", "second", "half", "zone")
#: The cascade over folded text: anchored pattern, and the group of each of `PARTS` (0: none).
CASCADE: list[tuple[str, tuple[int, ...]]] = [
    (rf"^{_DATE_YMD}$", (1, 2, 3, 0, 0, 0, 0, 0)),
    (rf"^{_DATE_DMY}$", (3, 2, 1, 0, 0, 0, 0, 0)),
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3, 0, 0, 0, 0, 0)),
    (rf"^{_DATE_YMD}[t ]{_CLOCK}{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 8)),
    (rf"^{_DATE_DMY}[t ,]\s?{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8)),
    (rf"^(\d{{1,2}}) gio (\d{{1,2}})(?: phut)?,? (?:ngay )?{_DATE_DMY}$", (5, 4, 3, 1, 2, 0, 0, 0)),
    (r"^(?:ngay )?(\d{1,2}) thang (\d{1,2}),? nam (\d{4})$", (3, 2, 1, 0, 0, 0, 0, 0)),
    (rf"^(?:[a-z]{{3,9}},? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}})$", (3, 2, 1, 0, 0, 0, 0, 0)),
    (rf"^(?:[a-z]{{3,9}},? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}) {_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8)),
]


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def utc_seconds(text: Column | str, zone_hint: Column | None = None, default_zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """Seconds since 1970-01-01 UTC that `text` names, or null.

    Patterns are tried in the order of `CASCADE`, each anchored at both ends;
    the first that matches decides, and a day or time that doesn't exist gives
    null. Bare digits: eight are a day, nine to eleven count seconds, more
    count milliseconds. Numeric dates are day first unless a four-digit year
    leads; two-digit years are 20YY. A number or abbreviation after the time
    is a fixed offset, a region name its rules. A time without zone is local
    time in `zone_hint`, or in `default_zone` where that is null or unknown.
    A local time that occurs twice is the first one; one that was skipped has
    the offset from before the change. Null, blank and sentinel texts give
    null, and so does any other text.
    """
    text = F.col(text) if isinstance(text, str) else text
    regions = {z.lower(): z for z in sorted(zoneinfo.available_timezones()) if "/" in z}
    named = _lookup(regions)
    hint = F.lit(None).cast("string") if zone_hint is None else F.try_element_at(named, F.lower(F.trim(zone_hint)))
    default = F.coalesce(hint, F.lit(default_zone))
    return _let(fold(squeeze(known(text, *UNKNOWN))), lambda plain: F.coalesce(_counted(plain), _let(_parts(plain), lambda p: _instant(p, named, default))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _counted(plain: Column) -> Column:
    digits = F.when(plain.rlike(r"^\d{9,18}$"), plain.try_cast("long"))
    count = F.when(F.length(plain) >= 12, F.floor(digits / 1000)).otherwise(digits)
    return F.when(count < 253402300800, count).cast("long")


def _parts(plain: Column) -> Column:
    """The texts of `PARTS` by the first pattern that matches, or null."""
    found = [
        F.when(plain.rlike(pattern), F.struct(*[(F.nullif(F.regexp_extract(plain, pattern, g), F.lit("")) if g else F.lit(None).cast("string")).alias(n) for n, g in zip(PARTS, groups)]))
        for pattern, groups in CASCADE
    ]
    return F.coalesce(*found)


def _instant(p: Column, named: Column, default: Column) -> Column:
    year = F.when(F.length(p.year) == 2, F.concat(F.lit("20"), p.year)).otherwise(p.year).try_cast("int")
    month = F.coalesce(F.try_element_at(_lookup(MONTHS), p.month), p.month.try_cast("int"))
    clock = F.coalesce(p.hour.try_cast("int"), F.lit(0))
    hour = F.when(p.half.isNull(), clock).when(clock.between(1, 12), clock % 12 + F.when(p.half == "p", 12).otherwise(0)).otherwise(99)
    second = F.coalesce(p.second.try_cast("int"), F.lit(0))
    wall = F.when(second < 60, F.try_make_timestamp(year, month, p.day.try_cast("int"), hour, F.coalesce(p.minute.try_cast("int"), F.lit(0)), second, F.lit("UTC")))
    offset = r"^([+-])(\d{2}):?(\d{2})?$"
    away = F.regexp_extract(p.zone, offset, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(p.zone, offset, 3).try_cast("int"), F.lit(0))
    sign = F.when(p.zone.rlike(offset), F.when(p.zone.startswith("-"), -1).otherwise(1))
    fixed = F.coalesce(sign * away, F.try_element_at(_lookup(ABBREVIATIONS), p.zone))
    region = F.when(p.zone.isNull(), default).otherwise(F.try_element_at(named, p.zone))
    by_offset = F.when(F.abs(fixed) <= 18 * 60, F.unix_seconds(wall) - fixed * 60)
    by_rules = F.when(region.isNotNull(), F.unix_seconds(F.to_utc_timestamp(wall, F.coalesce(region, F.lit("UTC")))))
    return F.when(fixed.isNotNull(), by_offset).otherwise(by_rules).cast("long")


def utc_text(seconds: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` in UTC of seconds since 1970, whatever the session's zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.substring((start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).cast("string"), 1, 19)
