"""Dates and times of listings, as Catalyst columns. Instants are milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_MINUTES = 180
ZONE = "Europe/Istanbul"
UNKNOWN_DATE = "UNKNOWN_DATE"
_DATE = "^(\\d{4})-(\\d{2})-(\\d{2})$"
_TIME = "^(\\d{1,2}):(\\d{2})"


def rolled_date(date: Column) -> Column:
    """yyyy-mm-dd as a date; days and months beyond their end roll over. null if it has another form."""
    part = lambda k: F.regexp_extract(date, _DATE, k).try_cast("int")
    return F.when(date.rlike(_DATE), F.date_add(F.add_months(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1))


def date_ms(date: Column) -> Column:
    return F.unix_date(rolled_date(date)).cast("bigint") * 86_400_000


def epoch_ms(date: Column, time: Column, offset_minutes: int | Column = OFFSET_MINUTES) -> Column:
    """null if either is missing or has another form, or the time is not one of a day."""
    hour, minute = (F.regexp_extract(time, _TIME, k).try_cast("int") for k in (1, 2))
    offset = offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)
    return F.when(time.rlike(_TIME) & (hour <= 23) & (minute <= 59), date_ms(date) + (hour * 60 + minute - offset).cast("bigint") * 60_000)


def shifted_day(date: Column, days: int | Column) -> Column:
    n = days if isinstance(days, Column) else F.lit(days)
    return F.date_format(F.date_add(rolled_date(date), n), "yyyy-MM-dd")


def stamp(date: Column, time: Column, offset_minutes: int = OFFSET_MINUTES) -> Column:
    return F.struct(date.alias("date"), time.alias("time"), epoch_ms(date, time, offset_minutes).alias("epoch"), date_ms(date).alias("date_epoch"))


def minutes_between(a: Column, b: Column) -> Column:
    """b - a in minutes, halves up."""
    return F.floor((b - a) / 60_000 + 0.5).cast("bigint")


def compare_times(date_a: Column, epoch_a: Column, date_b: Column, epoch_b: Column, tolerance: int = 0, max_adjacent: int = 2160) -> Column:
    """struct<diff_minutes, comparable, is_different, plausible>; without a time nothing is ruled out."""
    diff = minutes_between(epoch_a, epoch_b)
    known = diff.isNotNull()
    return F.struct(
        diff.alias("diff_minutes"),
        known.alias("comparable"),
        F.coalesce(F.abs(diff) > tolerance, F.lit(False)).alias("is_different"),
        F.when(known, date_a.eqNullSafe(date_b) | (F.abs(diff) <= max_adjacent)).otherwise(F.lit(True)).alias("plausible"),
    )


def _local(instant: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(instant, zone)
    known = F.struct(F.date_format(local, "yyyy-MM-dd").alias("date"), F.date_format(local, "HH:mm").alias("time"))
    return F.when(instant.isNotNull(), known).otherwise(F.struct(F.lit(UNKNOWN_DATE).alias("date"), F.lit("").alias("time")))


def local_from_ms(ms: Column, zone: str = ZONE) -> Column:
    """struct<date, time> in a zone; the unknown date where ms is null."""
    return _local(F.timestamp_millis(ms.cast("bigint")), zone)


def local_from_seconds(seconds: Column, zone: str = ZONE) -> Column:
    return local_from_ms(seconds.cast("bigint") * 1000, zone)


def parse_local(value: Column) -> Column:
    """struct<date, time> of "yyyy-mm-dd hh:mm[:ss]", taken as written."""
    form = "^(\\d{4}-\\d{2}-\\d{2})[T ](\\d{2}:\\d{2})(?::\\d{2})?"
    known = F.coalesce(value.rlike(form), F.lit(False))
    return F.struct(F.when(known, F.regexp_extract(value, form, 1)).otherwise(UNKNOWN_DATE).alias("date"), F.when(known, F.regexp_extract(value, form, 2)).otherwise("").alias("time"))
