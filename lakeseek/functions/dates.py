"""Dates that arrive as text in several formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(text: Column, pattern: str, *formats: str) -> Column:
    """Parsed where the text has the shape; null otherwise, also for dates that don't exist."""
    shaped = F.when(text.rlike(pattern), text)
    return F.coalesce(*[F.try_to_timestamp(shaped, F.lit(f)) for f in formats])


def parse_date(text: Column) -> Column:
    """dd-MM-yy or dd-MM-yyyy as yyyy-MM-dd; two-digit years from 69 on are 19xx; other text stays as it is; empty is null."""
    two = F.regexp_extract(text, r"^\d{1,2}-\d{1,2}-(\d{2})$", 1)
    century = F.when(two >= "69", "19").otherwise("20")
    long = F.when(two != "", F.concat(F.regexp_extract(text, r"^(\d{1,2}-\d{1,2}-)\d{2}$", 1), century, two)).otherwise(text)
    parsed = F.date_format(_checked(long, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), "yyyy-MM-dd")
    return F.when(text != "", F.coalesce(parsed, text))


def stored_end(text: Column) -> Column:
    """Timestamp of a stored deadline in one of four formats; blank, N/A and the rest are null."""
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.coalesce(
        _checked(clean, r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d-M-yyyy H:m:s"),
        _checked(clean, r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
        _checked(clean, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
        _checked(clean, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    )


def live_end(text: Column) -> Column:
    """Timestamp of a listed deadline; the trailing Z is part of the format, not a zone."""
    return _checked(text, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def extended(live: Column, stored: Column) -> Column:
    """Whether two deadlines differ by the minute, earlier or later; null if one is missing."""
    return F.date_trunc("minute", live) != F.date_trunc("minute", stored)


def is_new(added_at: Column, now: Column, days: int = 7) -> Column:
    """Added less than days before now and not after it. ISO text with Z, an offset or none (UTC); unreadable is not new."""
    at = F.try_to_timestamp(F.when(added_at.rlike(r"^\d{4}-\d{2}-\d{2}"), added_at))
    return F.coalesce((at <= now) & (at > now - F.make_dt_interval(F.lit(days))), F.lit(False))


def starts_before(start: Column, limit: Column) -> Column:
    """Start text (what is before T, yyyy-MM-dd) before the limit; null if unreadable."""
    return _checked(F.substring_index(start, "T", 1), r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d").cast("date") < limit


def ends_after(end: Column, limit: Column) -> Column:
    """End text (what is before a blank, yyyy-MM-dd or dd-MM-yyyy) after the limit; null if unreadable."""
    day = F.substring_index(end, " ", 1)
    return F.coalesce(_checked(day, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), _checked(day, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy")).cast("date") > limit


def india_date(at: Column) -> Column:
    """The calendar date in India of a UTC timestamp: the name of a run's folder."""
    return F.from_utc_timestamp(at, "Asia/Kolkata").cast("date")
