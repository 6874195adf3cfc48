"""Texts with a fixed spelling: predicates and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?"
_DATE = r"\d{4}-\d{2}-\d{2}"


def is_uuid(c: Column) -> Column:
    return c.rlike(r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z")


def is_decimal96(c: Column) -> Column:
    """Digits with at most 28 after the point, and a coefficient under 2^96."""
    digits = F.ltrim(F.regexp_replace(c, r"[-.]", ""), F.lit("0"))
    spelt = c.rlike(r"\A-?\d+(\.\d{1,28})?\z")
    small = (F.length(digits) < 29) | ((F.length(digits) == 29) & (digits <= "79228162514264337593543950335"))
    return spelt & small


def is_date(c: Column) -> Column:
    """Proleptic Gregorian days of the years 0000 to 9999."""
    return c.rlike(rf"\A{_DATE}\z") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull() & c.try_cast("date").isNotNull()


def is_local_time(c: Column) -> Column:
    return c.rlike(rf"\A{_TIME}\z")


def is_local_datetime(c: Column) -> Column:
    return c.rlike(rf"\A{_DATE}T{_TIME}\z") & is_date(F.substring(c, 1, 10))


def is_utc_instant(c: Column) -> Column:
    return c.rlike(r"Z\z") & is_local_datetime(F.regexp_replace(c, r"Z\z", ""))


def is_offset_datetime(c: Column) -> Column:
    """A local time with an offset in minutes; not -00:00, and in range in UTC too."""
    local, offset = F.regexp_replace(c, r"[+-]\d{2}:\d{2}\z", ""), F.regexp_extract(c, r"([+-]\d{2}:\d{2})\z", 1)
    spelt = c.rlike(rf"\A{_DATE}T{_TIME}[+-]([01]\d|2[0-3]):[0-5]\d\z") & (offset != "-00:00")
    minutes = F.substring(local, 12, 2).try_cast("int") * 60 + F.substring(local, 15, 2).try_cast("int")
    shift = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")
    early = local.startswith("0000-01-01") & offset.startswith("+") & (minutes < shift)
    late = local.startswith("9999-12-31") & offset.startswith("-") & (minutes + shift >= 1440)
    return spelt & is_local_datetime(local) & ~early & ~late


def canonical_time(c: Column) -> Column:
    """A time text with the shortest exact fraction."""
    return F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+(?=\z|Z|[+-]\d{2}:)", "$1"), r"\.(?=\z|Z|[+-]\d{2}:)", "")


CHECKS = {
    "uuid": is_uuid,
    "decimal96": is_decimal96,
    "date": is_date,
    "local_time": is_local_time,
    "local_datetime": is_local_datetime,
    "utc_instant": is_utc_instant,
    "offset_datetime": is_offset_datetime,
}
CANONICAL = {k: canonical_time for k in ("local_time", "local_datetime", "utc_instant", "offset_datetime")}
