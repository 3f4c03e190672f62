"""Activity statistics: daily, weekly and recent counts, backlog, usage and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.operators.lookups import recent_window
from palaver.operators.ordered import running

def live() -> Column:
    return F.col("source_type") == "live_conversation"


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def daily_stats(conv: DataFrame, date: str) -> DataFrame:
    """Counts for one date, zeros when the date has no rows."""
    return conv.filter(F.col("date") == date).agg(
        F.count("*").alias("total"),
        F.coalesce(_count_if(F.col("is_pair")), F.lit(0)).alias("pair"),
        F.coalesce(_count_if(F.col("source_type") == "self_talk"), F.lit(0)).alias("self_talk"),
        F.coalesce(_count_if(F.col("source_type") == "media_or_unknown"), F.lit(0)).alias("media"),
    )


def weekly_summary(conv: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per date over ``days`` + 1 inclusive dates."""
    return (
        recent_window(conv, as_of, days)
        .groupBy("date")
        .agg(
            F.count("*").alias("total"),
            _count_if(F.col("is_pair")).alias("pair"),
            _count_if(live()).alias("live"),
            F.round(F.avg("duration_seconds"), 1).alias("avg_duration"),
        )
    )


def quality_distribution(conv: DataFrame) -> DataFrame:
    return (
        conv.filter(live() & (F.col("quality") != "not_applicable"))
        .groupBy("quality")
        .agg(F.count("*").alias("n"))
    )


def pair_stats(conv: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return (
        recent_window(conv, as_of, days)
        .filter("is_pair")
        .agg(
            F.count("*").alias("total"),
            F.coalesce(F.round(F.sum("duration_seconds") / 60.0, 1), F.lit(0.0)).alias("minutes"),
            F.coalesce(F.round(F.avg("duration_seconds"), 1), F.lit(0.0)).alias("avg_seconds"),
            _count_if(F.col("quality") == "good").alias("good"),
            _count_if(F.col("quality") == "tense").alias("tense"),
        )
    )


def recent_stats(conv: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Total, pair count, counts by source type, and by quality among live rows.

    Every row names the levels it counts for, so one scan and one small aggregation serve all.
    """
    rows = recent_window(conv, as_of, days)
    levels = F.array(
        F.struct(F.lit("total").alias("level"), F.lit("").alias("name")),
        F.when(F.col("is_pair"), F.struct(F.lit("pair").alias("level"), F.lit("").alias("name"))),
        F.struct(F.lit("source_type").alias("level"), F.col("source_type").alias("name")),
        F.when(live(), F.struct(F.lit("quality").alias("level"), F.col("quality").alias("name"))),
    )
    return (
        rows.select(F.explode(F.array_compact(levels)).alias("l"))
        .groupBy("l.level", "l.name")
        .agg(F.count("*").alias("n"))
    )


def backlog_status(
    rows: DataFrame,
    seconds_per_conversation: float = 30.0,
    bitrate_kbps: float = 12.0,
    overflow_hours: float = 8.0,
) -> DataFrame:
    """Unprocessed hours and count with estimates of the work and cache they mean."""
    wait = F.col("processed_us").isNull()
    base = rows.filter(wait).agg(
        (F.coalesce(F.sum("duration_seconds"), F.lit(0.0)) / 3600.0).alias("total_hours"),
        F.count("*").alias("segment_count"),
        F.coalesce(F.min("captured_us"), F.lit(-1)).alias("oldest_captured_us"),
    )
    cleanup = F.col("segment_count") * F.lit(seconds_per_conversation) / 3600.0
    return base.select(
        "total_hours",
        "segment_count",
        "oldest_captured_us",
        cleanup.alias("cleanup_hours"),
        (F.col("total_hours") + cleanup).alias("processing_hours"),
        (F.col("total_hours") * F.lit(bitrate_kbps) * F.lit(0.45)).alias("cache_mb"),
        (F.col("total_hours") >= overflow_hours).alias("is_overflow"),
    )


def usage_for_day(usage: DataFrame, day: str) -> DataFrame:
    return usage.filter(F.col("day") == day).agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("audio_seconds"), F.lit(0.0)).alias("audio_seconds"),
        F.coalesce(F.sum("billed_seconds"), F.lit(0.0)).alias("billed_seconds"),
    )


def latest_conversation(conv: DataFrame) -> DataFrame:
    return conv.agg(
        F.max_by("conversation_id", F.struct("date", "start_us", "conversation_id")).alias(
            "conversation_id"
        )
    )


def period_change(totals: DataFrame, order: str = "date", value: str = "total") -> DataFrame:
    """Direction and percent against the period before. ``totals`` has one row per period, so the
    single-partition window stays as small as the number of periods."""
    prev = F.lag(value).over(Window.orderBy(order))
    pct = (F.col(value) - F.col("previous")) / F.col("previous") * 100.0
    zero = F.col("previous") == 0
    flat = F.abs(pct) < 1
    return totals.withColumn("previous", F.coalesce(prev, F.lit(0))).select(
        order,
        value,
        "previous",
        F.when(zero, F.when(F.col(value) > 0, "up").otherwise("neutral"))
        .when(flat, "neutral")
        .when(pct > 0, "up")
        .otherwise("down")
        .alias("direction"),
        F.when(zero | flat, 0.0).otherwise(F.abs(pct)).alias("percent"),
    )


def percent_of_total(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Rounded share of each category. ``counts`` has one row per category."""
    total = counts.agg(F.sum(n).alias("_total"))
    share = F.when(F.col("_total") == 0, 0).otherwise(
        F.floor(F.col(n) * 100.0 / F.col("_total") + 0.5)
    )
    return counts.join(F.broadcast(total)).select(by, n, share.cast("bigint").alias("percent"))


def backlog_growth(rows: DataFrame, key: str) -> DataFrame:
    """Running unprocessed seconds by event time, with the balance before and a growth flag.

    Each row adds its duration when captured and takes it off when processed.
    """
    add = rows.select(
        key,
        F.col("captured_us").alias("at_us"),
        F.lit(0).alias("kind"),
        F.col("segment_id"),
        F.col("duration_ms").alias("delta"),
    )
    ack = rows.filter(F.col("processed_us").isNotNull()).select(
        key,
        F.col("processed_us").alias("at_us"),
        F.lit(1).alias("kind"),
        F.col("segment_id"),
        (-F.col("duration_ms")).alias("delta"),
    )
    out = running(
        add.unionByName(ack),
        [key],
        ["at_us", "kind", "segment_id"],
        {"previous_ms": ("sum", F.col("delta"))},
    )
    now = F.col("previous_ms") + F.col("delta")
    return out.withColumn("balance_ms", now).withColumn(
        "growing", (F.col("previous_ms") > 0) & (F.col("balance_ms") > F.col("previous_ms"))
    )


def extrapolate_bench(results: DataFrame, hours_per_day: float = 4.5, budget_h: float = 8.0) -> DataFrame:
    """Mean real-time factor per model and the hours a day of speech would take."""
    hours = F.col("mean_rtf") * F.lit(hours_per_day)
    return (
        results.groupBy("model")
        .agg(F.avg("rtf").alias("mean_rtf"))
        .select("model", "mean_rtf", hours.alias("hours"), (hours <= budget_h).alias("fits"))
    )
