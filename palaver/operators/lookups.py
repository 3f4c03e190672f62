"""Filters and ordered pages over stored conversations and segments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import like_any


def days_before(as_of: str, days: int) -> str:
    return (dt.date.fromisoformat(as_of) - dt.timedelta(days=days)).isoformat()


def newest_first(df: DataFrame, limit: int, offset: int = 0, max_limit: int | None = None) -> DataFrame:
    """Page of conversations by date, start and id, newest first; ``max_limit`` caps what may be asked."""
    out = df.orderBy(F.desc("date"), F.desc("start_us"), F.desc("conversation_id"))
    out = out.offset(offset) if offset else out
    return out.limit(limit if max_limit is None else min(limit, max_limit))


def by_date(df: DataFrame, date: str | None, limit: int) -> DataFrame:
    """Newest conversations, of one date when given."""
    return newest_first(df if date is None else df.filter(F.col("date") == date), limit)


def by_id(df: DataFrame, conversation_id: int) -> DataFrame:
    return df.filter(F.col("conversation_id") == conversation_id)


def recent_window(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of``. The date column stays bare for pruning."""
    return df.filter((F.col("date") >= days_before(as_of, days)) & (F.col("date") <= as_of))


def by_participant(
    df: DataFrame, who: str, as_of: str, days: int = 7, limit: int = 50, compat: bool = False
) -> DataFrame:
    """Recent conversations of a participant. ``compat`` matches any substring of the name list."""
    if compat:
        hit = F.contains(F.to_json("participants"), F.lit(who))
    else:
        hit = F.array_contains("participants", who)
    return newest_first(recent_window(df, as_of, days).filter(hit), limit)


def by_quality(df: DataFrame, quality: str, as_of: str, days: int = 7, limit: int = 50) -> DataFrame:
    live = (F.col("quality") == quality) & (F.col("source_type") == "live_conversation")
    return newest_first(recent_window(df, as_of, days).filter(live), limit)


def like_search(df: DataFrame, needle: str, columns: list[str], limit: int, offset: int = 0) -> DataFrame:
    hits = df.filter(like_any([F.col(c) for c in columns], needle))
    return newest_first(hits, limit, offset)


def oldest_pending(staged: DataFrame, limit: int) -> DataFrame:
    """Unprocessed segments, oldest capture first."""
    return (
        staged.filter(F.col("processed_us").isNull())
        .orderBy("captured_us", "segment_id")
        .limit(limit)
    )


def batch_size(hours: float, mean_segment_s: float = 10.0) -> int:
    """Segments that make up so many hours of speech."""
    return int(hours * 3600 / mean_segment_s)


def update_by_key(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Set one column for the keys of ``changes`` (unique keys)."""
    new = changes.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def unmatched_keys(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Keys of ``changes`` that ``df`` does not have."""
    return changes.join(df.select(key), key, "left_anti").select(key)


def in_range(values: dict[str, str], limits: dict[str, tuple[float, float]]):
    """Names of the settings outside their bounds, as an array column."""
    return F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.col(values[k]).between(lo, hi), F.lit(False)), k)
                for k, (lo, hi) in limits.items()
            ]
        )
    )
