"""Dates, times and durations from integer microseconds.

Journal days follow a fixed-offset zone (+05:30, no daylight saving), as a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOURNAL_OFFSET_US = 19_800_000_000
DAY_US = 86_400_000_000


def floor_div(col: Column, n: int) -> Column:
    """Integer division that rounds down, also for times before the epoch.

    The quotient of a whole number below 2^53 is never rounded up to the next whole number.
    """
    return F.floor(col / F.lit(n))


def local_day(us: Column, offset_us: int = JOURNAL_OFFSET_US) -> Column:
    shifted = us + F.lit(offset_us)
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(shifted, DAY_US).cast("int"))


def local_date(us: Column, offset_us: int = JOURNAL_OFFSET_US) -> Column:
    """Local calendar date as ``YYYY-MM-DD`` text."""
    return local_day(us, offset_us).cast("string")


def local_time(us: Column, offset_us: int = JOURNAL_OFFSET_US) -> Column:
    """Local clock time as ``HH:MM:SS`` text."""
    from palaver.functions.text import let

    def clock(sec: Column) -> Column:
        parts = (floor_div(sec, 3600), F.pmod(floor_div(sec, 60), F.lit(60)), F.pmod(sec, F.lit(60)))
        return F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])

    return let(floor_div(F.pmod(us + F.lit(offset_us), F.lit(DAY_US)), 1_000_000), clock)


def local_hour(us: Column, offset_us: int = JOURNAL_OFFSET_US) -> Column:
    return floor_div(F.pmod(us + F.lit(offset_us), F.lit(DAY_US)), 3_600_000_000)


def naive_to_local_date(ts: Column, naive_is_local: bool) -> Column:
    """Local date of a naive timestamp: taken as local already, or as UTC and shifted."""
    us = F.unix_micros(ts.cast("timestamp"))
    return local_date(us, 0 if naive_is_local else JOURNAL_OFFSET_US)


def duration_s(start_us: Column, end_us: Column) -> Column:
    """Seconds between two instants, never negative."""
    return F.greatest(end_us - start_us, F.lit(0).cast("bigint")) / F.lit(1e6)


def duration_ms(start_us: Column, end_us: Column) -> Column:
    return floor_div(F.greatest(end_us - start_us, F.lit(0).cast("bigint")), 1000)


def parse_canonical_date(text: Column) -> Column:
    """A date only when the text is exactly its ``YYYY-MM-DD`` form, else null."""
    d = F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & (d.cast("string") == text), d)


def format_duration(seconds: Column) -> Column:
    """``42s``, ``3m`` or ``3m 5s``; seconds round half up first."""
    s = F.floor(seconds + 0.5).cast("bigint")
    m, r = floor_div(s, 60), F.pmod(s, F.lit(60))
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(r > 0, F.concat(m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s")))
        .otherwise(F.concat(m.cast("string"), F.lit("m")))
    )


def format_hours_minutes(seconds: Column) -> Column:
    """``2h 5m``, ``2h``, ``5m`` or ``42s`` for whole seconds."""
    s = seconds.cast("bigint")
    h, m = floor_div(s, 3600), floor_div(F.pmod(s, F.lit(3600)), 60)
    hs, ms = F.concat(h.cast("string"), F.lit("h")), F.concat(m.cast("string"), F.lit("m"))
    return (
        F.when((h > 0) & (m > 0), F.concat_ws(" ", hs, ms))
        .when(h > 0, hs)
        .when(m > 0, ms)
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def format_time_12h(hms: Column) -> Column:
    """``13:05:09`` becomes ``1:05 PM``."""
    h = F.split_part(hms, F.lit(":"), F.lit(1)).cast("int")
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(
        h12.cast("string"),
        F.lit(":"),
        F.split_part(hms, F.lit(":"), F.lit(2)),
        F.when(h >= 12, " PM").otherwise(" AM"),
    )


def relative_day(date: Column, as_of: Column) -> Column:
    """``Today``, ``Yesterday``, ``N days ago`` under a week, else ``Mon, Jan 1``."""
    n = F.datediff(as_of.cast("date"), date.cast("date"))
    return (
        F.when(n == 0, "Today")
        .when(n == 1, "Yesterday")
        .when(n < 7, F.concat(n.cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format(date.cast("date"), "EEE, MMM d"))
    )


def distance_to_now(us: Column, now_us: Column) -> Column:
    """``3d ago``, ``2h ago``, ``5m ago`` or ``just now``."""
    s = floor_div(now_us - us, 1_000_000)
    m = floor_div(s, 60)
    h = floor_div(m, 60)
    d = floor_div(h, 24)
    return (
        F.when(d > 0, F.concat(d.cast("string"), F.lit("d ago")))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h ago")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m ago")))
        .otherwise("just now")
    )


def shift_offset(start_us: Column, samples: Column, rate: int) -> Column:
    """Instant of a sample offset inside an interval."""
    return start_us + F.round(samples * F.lit(1e6) / F.lit(rate)).cast("bigint")


def midpoint_us(start_us: Column, end_us: Column) -> Column:
    return start_us + floor_div(end_us - start_us, 2)


def in_hour_window(hour: Column, start: int, end: int, enabled: bool = True) -> Column:
    """Hour-of-day test; a start after the end wraps over midnight."""
    if not enabled:
        return F.lit(False)
    if start > end:
        return (hour >= start) | (hour < end)
    return (hour >= start) & (hour < end)
