"""Timestamps and durations, as columns. Timestamps have no time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds (double, with the microseconds) from start to end."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def microseconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def gap_minutes(before: Column, at: Column, wrap_days: bool = False) -> Column:
    """Minutes between captures; with `wrap_days` whole days are left out, as the older rule did."""
    seconds = F.floor(seconds_between(before, at))
    return (F.pmod(seconds, F.lit(86_400)) if wrap_days else seconds) / F.lit(60.0)


def duration_minutes(start: Column, end: Column) -> Column:
    """Whole minutes, halves to even."""
    return F.bround(F.floor(seconds_between(start, end)) / F.lit(60.0), 0).cast("int")


def duration_label(start: Column, end: Column) -> Column:
    """"N hour(s)" of the part below a day, halves to even."""
    hours = F.bround(F.pmod(F.floor(seconds_between(start, end)), F.lit(86_400)) / F.lit(3600.0), 0).cast("int")
    return F.when(start.isNull() | end.isNull(), "").otherwise(F.concat(hours.cast("string"), F.when(hours == 1, " hour").otherwise(" hours")))


def clock_label(seconds: Column) -> Column:
    """h:mm:ss of a number of seconds."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def seconds_per_item(seconds: Column, items: Column) -> Column:
    """Null for no items."""
    return F.when(items > 0, seconds / items)


def batches(items: Column, size: int) -> Column:
    """Batches of `size` that so many items fill, the last one perhaps in part."""
    return F.ceil(items / F.lit(float(size))).cast("long")


def timestamp_in_name(path: Column) -> Column:
    """The first 14 digits in a row of a file's name as a timestamp, else the whole stem read as a date; else null."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d{14})", 1)
    spaced = F.regexp_replace(stem, "_", "-")
    full = F.when(digits != "", _try_ntz(digits, "yyyyMMddHHmmss"))
    iso = F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"), _try_ntz(F.replace(stem, F.lit("T"), F.lit(" ")), "yyyy-MM-dd HH:mm:ss"))
    day = F.when(spaced.rlike(r"^\d{4}-\d{2}-\d{2}$"), _try_ntz(spaced, "yyyy-MM-dd"))
    plain = F.when(stem.rlike(r"^\d{8}$"), _try_ntz(stem, "yyyyMMdd"))
    return F.coalesce(full, iso, day, plain)


def _try_ntz(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def with_offset(local: Column, offset: str = "+00:00") -> Column:
    """A local time at a fixed offset, as an instant."""
    return F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(offset)), "yyyy-MM-dd HH:mm:ssXXX")


def folder_day(name: Column) -> Column:
    """The day that a folder is named for; null where its name is no day."""
    return F.try_to_date(F.replace(name, F.lit("_"), F.lit("-")), "yyyy-MM-dd")
