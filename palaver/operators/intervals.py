"""Interval joins and arithmetic on timelines, frames and words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.timefmt import floor_div
from palaver.operators.ordered import SLOT_US, running
from palaver.operators.sessions import islands, to_us


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    hop: int,
) -> DataFrame:
    """Pairs of half-open intervals that overlap, inner, with an equi-join on time buckets.

    Both sides name every bucket of width ``hop`` they touch. A pair is kept only in the later of
    the two first buckets, so it appears once and needs no distinct. Set ``hop`` near the usual
    interval length. Overlapping column names must already differ, apart from ``keys``.
    """

    def bucketed(df: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        first = floor_div(F.col(span[0]), hop)
        last = F.greatest(floor_div(F.col(span[1]) - 1, hop), first)
        return df.withColumn(f"_f{tag}", first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    a, b = bucketed(left, left_span, "l"), bucketed(right, right_span, "r")
    hit = (
        (F.col(left_span[0]) < F.col(right_span[1]))
        & (F.col(left_span[1]) > F.col(right_span[0]))
        & (F.col("_bucket") == F.greatest("_fl", "_fr"))
    )
    return a.join(b, [*keys, "_bucket"]).filter(hit).drop("_bucket", "_fl", "_fr")


def words_in_core(df: DataFrame, words: str, core_start: Column, core_end: Column, rate: int) -> dict[str, Column]:
    """Text of the words whose midpoint lies in the core, and a status.

    Without words, or with a word that lacks a time, the text is a review marker.
    """
    from palaver.functions.text import trim_ws

    missing = F.coalesce(F.size(words) < 1, F.lit(True)) | F.coalesce(
        F.exists(words, lambda w: w["start"].isNull() | w["end"].isNull() | w["word"].isNull()), F.lit(True)
    )
    own = F.filter(
        words,
        lambda w: ((w["start"] + w["end"]) / 2 * rate >= core_start)
        & ((w["start"] + w["end"]) / 2 * rate < core_end),
    )
    text = F.array_join(F.transform(own, lambda w: trim_ws(w["word"])), " ")
    return {
        "text": F.when(missing, "[Boundary transcript needs review]").otherwise(text),
        "status": F.when(missing, "boundary_timestamps_missing").otherwise(""),
    }


def timeline_layout(
    df: DataFrame,
    keys: list[str],
    ident: str,
    rate: int = 16_000,
    fade_gap_s: float = 0.025,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """Place clips of a conversation on one timeline.

    Adds the sample offset from the first clip, the silence to insert before the clip, the samples
    to skip where it overlaps what is already written, and fade flags beside longer gaps.
    """
    origin = df.groupBy(*keys).agg(F.min("start_us").alias("_origin"))
    rows = df.join(origin, keys)

    def samples(us: Column) -> Column:
        return F.round((us - F.col("_origin")) * F.lit(float(rate)) / F.lit(1e6)).cast("bigint")

    rows = rows.withColumn("offset", samples(F.col("start_us"))).withColumn(
        "_end", samples(F.col("start_us")) + F.round((F.col("end_us") - F.col("start_us")) * F.lit(float(rate)) / F.lit(1e6)).cast("bigint")
    )
    order = ["start_us", ident]
    rows = running(
        rows,
        keys,
        order,
        {"_cursor": ("max", F.col("_end")), "_pe": ("last", F.col("end_us"))},
        slot_us=slot_us,
    )
    # The next start, seen from the row before it, is the same scan run backwards.
    back = rows.withColumn("_neg", -F.col("start_us")).withColumn(
        "_place", F.struct(F.col("start_us"), F.col(ident))
    )
    nxt = running(
        back.withColumn("_inv", F.row_number().over(_tie_window(keys, ident))),
        keys,
        ["_neg", "_inv"],
        {"_ns": ("last", F.col("start_us"))},
        slot_us=slot_us,
    )
    cursor = F.coalesce("_cursor", F.lit(0))
    far = to_us(fade_gap_s)
    return nxt.select(
        *df.columns,
        "offset",
        F.greatest(F.col("offset") - cursor, F.lit(0)).alias("silence"),
        F.greatest(cursor - F.col("offset"), F.lit(0)).alias("skip"),
        (F.col("_pe").isNull() | (F.col("start_us") - F.col("_pe") > far)).alias("fade_in"),
        (F.col("_ns").isNull() | (F.col("_ns") - F.col("end_us") > far)).alias("fade_out"),
    )


def _tie_window(keys: list[str], ident: str):
    """Order among rows that share key and start, latest id first."""
    from pyspark.sql import Window

    return Window.partitionBy(*keys, "start_us").orderBy(F.desc(ident))


def pad_clip(df: DataFrame, pad_s: float, low: Column, high: Column) -> DataFrame:
    """Pad both ends of an interval and clip it to the bounds."""
    p = to_us(pad_s)
    return df.withColumn("start_us", F.greatest(F.col("start_us") - p, low)).withColumn(
        "end_us", F.least(F.col("end_us") + p, high)
    )


def min_duration(df: DataFrame, seconds: float) -> DataFrame:
    return df.filter(F.col("end_us") - F.col("start_us") >= to_us(seconds))


def silence_boundaries(
    frames: DataFrame, key: str, index: str = "frame", db: str = "db", below: float = -45.0, hop: int = 1
) -> DataFrame:
    """Middle of each run of quiet frames, in the unit of ``hop``."""
    runs = islands(frames.filter(F.col(db) < below).select(key, index), [key], index)
    g = runs.groupBy(key, "island").agg(F.min(index).alias("_a"), F.max(index).alias("_b"))
    return g.select(key, (floor_div(F.col("_a") + F.col("_b"), 2) * hop).alias("boundary"))


def lowest_energy_cut(frames: DataFrame, key: str, index: str = "frame", energy: str = "energy") -> DataFrame:
    """Quietest frame per key, the first on ties."""
    return frames.groupBy(key).agg(F.min_by(index, F.struct(energy, index)).alias("cut"))


def chunk_at_silence(
    clips: DataFrame,
    boundaries: DataFrame,
    key: str,
    target: float = 15.0,
    shortest: float = 3.0,
    longest: float = 30.0,
    snap: bool = False,
) -> DataFrame:
    """Consecutive chunks of about ``target`` seconds over each clip.

    By default a chunk ends exactly at the target: a boundary is taken only when it is nearer than
    the target itself, which never happens. ``snap`` moves the cut to the boundary nearest the
    target within [shortest, longest], and depends on the cut before it, so a clip is walked once.
    """
    fixed = clips.withColumn(
        "chunk_no",
        F.explode(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / F.lit(target)), F.lit(1)).cast("int") - 1)
        ),
    )
    if not snap:
        return fixed.select(
            key,
            F.col("chunk_no").cast("bigint").alias("chunk_no"),
            (F.col("chunk_no") * F.lit(target)).alias("start"),
            F.least((F.col("chunk_no") + 1) * F.lit(target), F.col("duration")).alias("end"),
        )
    # One clip is one recording, so its boundary list is bounded by the length of the recording.
    lists = boundaries.groupBy(key).agg(F.sort_array(F.collect_list("boundary")).alias("bounds"))
    rows = clips.join(lists, key, "left").select(key, "duration", "bounds")
    kind = dict(clips.dtypes)[key]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, duration, bounds in zip(pdf[key], pdf["duration"], pdf["bounds"]):
                bounds = [] if bounds is None else list(bounds)
                start, no = 0.0, 0
                while start < duration:
                    goal = min(start + target, duration)
                    near = [b for b in bounds if start + shortest <= b <= min(start + longest, duration)]
                    end = min(near, key=lambda b: (abs(b - goal), b)) if near and goal < duration else goal
                    out.append((k, no, start, end))
                    start, no = end, no + 1
            yield pd.DataFrame(out, columns=[key, "chunk_no", "start", "end"])

    return rows.mapInPandas(walk, f"{key} {kind}, chunk_no bigint, start double, end double")


def gap_fill(frames: DataFrame, key: str, slot: str = "slot", value: str = "value", order: str = "start_us") -> DataFrame:
    """Every slot of each timeline, zero where no frame lies, the latest start where several do."""
    latest = frames.groupBy(key, slot).agg(F.max_by(value, F.col(order)).alias(value))
    span = frames.groupBy(key).agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
    grid = span.select(key, F.explode(F.sequence("_a", "_b")).alias(slot))
    return grid.join(latest, [key, slot], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def frame_snr(frames: DataFrame, key: str, db: str = "db", min_frames: int = 10) -> DataFrame:
    """Signal over noise in dB: median of the loud frames less the tenth percentile, at least 0."""
    q = frames.groupBy(key).agg(
        F.count("*").alias("n"),
        F.percentile(db, 0.1).alias("noise"),
        F.percentile(db, 0.7).alias("_p70"),
    )
    loud = frames.join(q, key).filter(F.col(db) >= F.col("_p70"))
    sig = loud.groupBy(key).agg(F.percentile(db, 0.5).alias("signal"))
    snr = F.greatest(F.lit(0.0), F.col("signal") - F.col("noise"))
    return q.join(sig, key).select(
        key, "n", F.when(F.col("n") < min_frames, 0.0).otherwise(snr).alias("snr")
    )
