"""Service-day seconds, dates and clock times as Column expressions. Seconds may pass 86,400 or be negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DETOUR, SPEED = 1.35, 1.2


def parse_gtfs_time(text: Column) -> Column:
    """`H:MM:SS` as seconds; hours may pass 24; characters other than digits and colons don't count."""
    def of(parts: Column) -> tuple[Column, Column, Column]:
        return F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int"), F.get(parts, 2).try_cast("int")

    # a plain text needs no pattern; whatever has other signs, or a part that is no number, takes the second way
    raw = F.split(text, ":")
    h, m, s = of(raw)
    plain = h.isNotNull() & m.isNotNull() & (s.isNotNull() | (F.size(raw) == 2)) & ~F.contains(text, F.lit("-"))
    parts = F.split(F.regexp_replace(text, "[^0-9:]", ""), ":")
    h2, m2, s2 = of(parts)
    zero = F.lit(0)
    return F.when(plain, h * 3600 + m * 60 + F.coalesce(s, zero)).when(F.size(parts) >= 2, h2 * 3600 + m2 * 60 + F.coalesce(s2, zero))


def clock(seconds: Column) -> Column:
    """Seconds from 0 on as `H:MM:SS`; hours may pass 24."""
    two = lambda v: F.lpad(v.cast("int").cast("string"), 2, "0")
    return F.concat((seconds / 3600).cast("int").cast("string"), F.lit(":"), two(seconds % 3600 / 60), F.lit(":"), two(seconds % 60))


def parse_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def weekday(epoch_day: Column) -> Column:
    """Monday 0."""
    return F.pmod(epoch_day + 3, F.lit(7))


def service_day_time(day: Column, seconds: Column) -> Column:
    """Wall clock of a service day: seconds are added to civil midnight, so a clock change doesn't move it."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def seconds_of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def hhmm(seconds: Column) -> Column:
    s = F.pmod(seconds, F.lit(86400))
    return F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"))


def walk_seconds(metres: Column, speed: float = SPEED) -> Column:
    """Of straight-line metres."""
    return F.round(metres * F.lit(DETOUR) / F.lit(speed)).cast("int")


def minutes_until(seconds: Column) -> Column:
    return F.when(seconds <= 30, 0).otherwise(F.ceil(seconds / 60)).cast("int")


def minutes_late(seconds: Column) -> Column:
    return F.round(seconds / 60).cast("int")


def picked_day(day: Column, picked: Column, now: Column) -> Column:
    """A picked clock time more than 30 minutes past means tomorrow."""
    return F.when(picked < now - 1800, F.date_add(day, 1)).otherwise(day)


def update_due(seconds_since: Column, forced: Column, has_version: Column, file_there: Column, etag: Column) -> Column:
    """(due, etag) of a check for a newer file: due when forced, never checked, or a day after the last check; the etag goes along
    only unless forced, and only while the file that it stands for is there."""
    due = forced | seconds_since.isNull() | (seconds_since >= 86400)
    return F.struct(due.alias("due"), F.when(~forced & (~has_version | file_there), etag).alias("etag"))
