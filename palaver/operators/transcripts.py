"""Ordered text of conversations, in parts that bound what one task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.quality import language_policy, prompt_echo, signature_flag
from palaver.functions.timefmt import floor_div
from palaver.operators.ordered import SLOT_US, running

# A conversation of more lines than this comes as several rows, numbered by ``part``.
PART_ROWS = 10_000


def with_position(
    df: DataFrame, keys: list[str], order: list[str], slot_us: int = SLOT_US
) -> DataFrame:
    """Add ``position``, the 0-based place of a row inside its key."""
    one = {"position": ("sum", F.lit(1).cast("bigint"))}
    return running(df, keys, order, one, slot_us=slot_us)


def ordered_parts(
    df: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS, **items: Column
) -> DataFrame:
    """One row per (key, part) with ``array<struct>`` columns in order.

    Parts hold at most ``part_rows`` rows, so no array grows with a hot key, and the parts of a key
    put one after the other are the whole list.
    """
    pos = with_position(df, keys, order)
    parts = pos.groupBy(*keys, floor_div(F.col("position"), part_rows).alias("part")).agg(
        F.sort_array(
            F.collect_list(F.struct("position", *[c.alias(n) for n, c in items.items()]))
        ).alias("items")
    )
    return parts


def joined(field: str, sep: str = "\n", items: str = "items") -> Column:
    return F.array_join(F.transform(items, lambda x: x[field]), sep)


def first_seen(df: DataFrame, keys: list[str], order: list[str], column: str, alias: str) -> DataFrame:
    """Distinct values of a column per key in the order they first appear."""
    seen = df.groupBy(*keys, column).agg(F.min(F.struct(*order)).alias("_at"))
    return seen.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_at", F.col(column).alias("v")))), lambda x: x["v"]
        ).alias(alias)
    )


def conversation_rollup(
    df: DataFrame, key: str = "conv_id", ident: str = "segment_id", part_rows: int = PART_ROWS
) -> DataFrame:
    """Bounds, participants as first seen, sorted languages, quality and ordered text."""
    stats = df.groupBy(key).agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias(
            "languages"
        ),
        F.when(F.bool_and(F.col("status") == "ok"), "ok").otherwise("needs_review").alias("quality"),
    )
    who = first_seen(df, [key], ["start_us", ident], "speaker", "participants")
    text = ordered_parts(df, [key], ["start_us", ident], part_rows, text=F.col("text"))
    return (
        stats.join(who, key)
        .join(text.select(key, "part", joined("text").alias("transcript")), key)
        .withColumn("duration_seconds", (F.col("end_us") - F.col("start_us")) / 1e6)
    )


def daily_rollup(df: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Per local date: seconds, count, first start, last end, and the day's text in parts.

    First and last follow event time, and blank lines are left out of the text.
    """
    from palaver.functions.text import trim_ws
    from palaver.functions.timefmt import local_time

    stats = df.groupBy("date").agg(
        F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"),
        F.count("*").alias("segment_count"),
        F.min_by("start_us", F.struct("start_us", "segment_id")).alias("first_us"),
        F.max_by("end_us", F.struct("start_us", "segment_id")).alias("last_us"),
    )
    line = F.concat(
        F.lit("["), local_time(F.col("start_us")), F.lit("] ("), F.col("language"), F.lit(") "), trim_ws(F.col("text"))
    )
    spoken = df.filter(trim_ws(F.col("text")) != "")
    parts = ordered_parts(spoken, ["date"], ["start_us", "segment_id"], part_rows, line=line)
    text = parts.select("date", "part", joined("line").alias("transcript"))
    return (
        stats.join(text, "date", "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("transcript", F.coalesce("transcript", F.lit("")))
    )


def review_flags(members: DataFrame, key: str = "conv_id", imported: str | None = None) -> DataFrame:
    """Sorted review flags per conversation: member states and policy violations, else the
    signature flag, and the prompt echo on top."""
    is_live = F.lit(True) if imported is None else ~F.col(imported)
    state = F.when(~F.col("status").isin("ok", "imported"), F.col("status"))
    policy = F.when(is_live, language_policy(F.col("text"), F.col("language")))
    g = members.groupBy(key).agg(
        F.collect_set(state).alias("_states"),
        F.collect_set(policy).alias("_policy"),
        F.bool_or(signature_flag(F.col("text"))).alias("_sig"),
        F.bool_or(prompt_echo(F.col("text"))).alias("_echo"),
    )
    own = F.array_union("_states", "_policy")
    none = F.array().cast("array<string>")
    base = F.when(F.size(own) > 0, own).when(
        F.col("_sig"), F.array(F.lit("suspected_hallucination"))
    ).otherwise(none)
    echo = F.when(F.col("_echo"), F.array(F.lit("suspected_prompt_echo"))).otherwise(none)
    return g.select(key, F.sort_array(F.array_union(base, echo)).alias("review_flags"))


def conversation_payload(
    conv: DataFrame, members: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """Conversations with ordered turns, review flags and the state of their first segment."""
    m = members.withColumnRenamed("conv_id", "conversation_id")
    turns = ordered_parts(
        m,
        ["conversation_id"],
        ["start_us", "segment_id"],
        part_rows,
        start_us=F.col("start_us"),
        end_us=F.col("end_us"),
        text=F.col("text"),
        speaker=F.col("speaker"),
        status=F.col("status"),
    ).withColumnRenamed("items", "turns")
    first = m.groupBy("conversation_id").agg(
        F.min_by(F.struct("segment_id", "status", "engine"), F.struct("start_us", "segment_id")).alias("_f")
    )
    flags = review_flags(m, "conversation_id")
    out = (
        conv.join(turns, "conversation_id", "left")
        .join(first, "conversation_id", "left")
        .join(flags, "conversation_id", "left")
    )
    none = F.array().cast("array<string>")
    raw = F.coalesce(F.nullif("raw_transcript", F.lit("")), F.col("transcript"), F.lit(""))
    sig = signature_flag(raw)
    flag_col = F.when(F.size(F.coalesce("review_flags", none)) > 0, F.col("review_flags")).when(
        sig, F.array(F.lit("suspected_hallucination"))
    ).otherwise(none)
    return (
        out.withColumn("raw", raw)
        .withColumn("review_flags", flag_col)
        .withColumn("engine", F.coalesce("_f.engine", F.lit("legacy")))
        .withColumn(
            "status",
            F.coalesce(
                "_f.status", F.when(F.size("review_flags") > 0, "suspected_hallucination"), F.lit("legacy")
            ),
        )
        .withColumn("segment_id", F.coalesce("_f.segment_id", F.lit("")))
        .drop("_f")
    )
