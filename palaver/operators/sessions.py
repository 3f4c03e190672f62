"""Gap sessions: merged units, conversations, capped sessions, span islands, long-interval cuts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.timefmt import local_date
from palaver.operators.ordered import SLOT_US, running, slot_key, slots_in_order, unpacked

US = 1_000_000


def to_us(seconds: float) -> int:
    return int(round(seconds * US))


def previous_end(
    df: DataFrame, keys: list[str], ident: str, latest: bool = False, slot_us: int = SLOT_US
) -> DataFrame:
    """Add ``prev_end``: the end of the row before, or with ``latest`` the greatest end so far."""
    kind = "max" if latest else "last"
    return running(
        df, keys, ["start_us", ident], {"prev_end": (kind, F.col("end_us"))}, slot_us=slot_us
    )


def assign_sessions(
    df: DataFrame, keys: list[str], ident: str, opens: Column, slot_us: int = SLOT_US
) -> DataFrame:
    """Add ``session_start_us`` and ``session_first``: the row that opened the current session."""
    first = F.when(opens, F.struct(F.col("start_us").alias("s"), F.col(ident).alias("i")))
    out = running(
        df, keys, ["start_us", ident], {"_open": ("last", first)}, inclusive=True, slot_us=slot_us
    )
    return (
        out.withColumn("session_start_us", F.col("_open.s"))
        .withColumn("session_first", F.col("_open.i"))
        .drop("_open")
    )


def gap_sessions(
    df: DataFrame,
    keys: list[str],
    ident: str,
    max_gap_s: float,
    slot_us: int = SLOT_US,
    previous: list[str] = [],
) -> DataFrame:
    """Label rows with their gap session: a gap above ``max_gap_s`` from the row before opens one.

    Overlapping rows have a negative gap and stay together. Adds ``prev_end``, the session's first
    row, and ``prev_<column>`` for each of ``previous``. Works slot by slot like
    ``operators.ordered``, with both the previous end and the open session in one summary row.
    """
    at = F.struct(F.col("start_us").alias("s"), F.col(ident).alias("i"))
    kept = F.struct("end_us", *previous)
    w = Window.partitionBy("_key").orderBy("start_us", ident)
    across = slots_in_order(keys)
    rows = df.withColumn("_key", slot_key(keys, "start_us", slot_us)).withColumn(
        "_before", F.lag(kept).over(w)
    )
    far = F.col("start_us") - F.col("_before.end_us") > to_us(max_gap_s)
    rows = rows.withColumn("_opened", F.when(far, at))
    edges = rows.groupBy(F.col("_key").alias("_edge")).agg(
        F.min(at).alias("_first"),
        F.max_by(kept, at).alias("_last"),
        F.max("_opened").alias("_last_open"),
    )
    edges = unpacked(edges, keys).withColumn("_carry", F.lag("_last").over(across))
    new = F.col("_carry").isNull() | (F.col("_first.s") - F.col("_carry.end_us") > to_us(max_gap_s))
    edges = edges.withColumn("_open_first", F.when(new, F.col("_first")))
    open_here = F.coalesce("_last_open", "_open_first")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn(
        "_open_in", F.coalesce("_open_first", F.last(open_here, ignorenulls=True).over(earlier))
    ).select("_edge", "_carry", "_open_in")
    rows = rows.withColumn(
        "_open_here", F.max("_opened").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    out = rows.join(edges, F.col("_key") == F.col("_edge"))
    session = F.coalesce("_open_here", "_open_in")
    before = F.coalesce("_before", "_carry")
    return out.select(
        *df.columns,
        before["end_us"].alias("prev_end"),
        *[before[c].alias(f"prev_{c}") for c in previous],
        session["s"].alias("session_start_us"),
        session["i"].alias("session_first"),
    )


def merge_segments(
    df: DataFrame,
    keys: list[str] = ["device_id"],
    ident: str = "segment_id",
    max_gap_s: float = 2.5,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """Merged units. The unit ends where its last row ends; only positive gaps are counted."""
    labelled = gap_sessions(df, keys, ident, max_gap_s, slot_us)
    inside = F.col("session_first") != F.col(ident)
    gap = F.when(inside, F.greatest(F.col("start_us") - F.col("prev_end"), F.lit(0)))
    speech = F.sum(F.col("end_us") - F.col("start_us"))
    unit = labelled.groupBy(*keys, "session_start_us", "session_first").agg(
        F.max_by("end_us", F.struct("start_us", ident)).alias("end_us"),
        F.count("*").alias("merge_count"),
        F.sum((F.coalesce(gap, F.lit(0)) > 0).cast("bigint")).alias("gaps_merged"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("total_gap_us"),
        speech.alias("speech_us"),
    )
    span = F.col("end_us") - F.col("session_start_us")
    return unit.select(
        *keys,
        F.col("session_first").alias("unit_id"),
        F.col("session_start_us").alias("start_us"),
        "end_us",
        "merge_count",
        "gaps_merged",
        "total_gap_us",
        "speech_us",
        F.when(span > 0, F.col("speech_us") / span).otherwise(0.0).alias("speech_ratio"),
        (F.col("speech_us") / F.col("merge_count") / US).alias("avg_source_s"),
    )


def split_interval(df: DataFrame, max_s: float, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Cut intervals longer than ``max_s`` into consecutive pieces, the last one shorter."""
    m = to_us(max_s)
    span = F.col(end) - F.col(start)
    n = F.greatest(F.ceil(span / F.lit(m)), F.lit(1))
    return (
        df.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
        .withColumn("piece_start_us", F.col(start) + F.col("piece_no") * m)
        .withColumn("piece_end_us", F.least(F.col("piece_start_us") + m, F.col(end)))
    )


def _bisect(starts, ends, lo: int, hi: int, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``limit`` length, cut after the row whose end is nearest the middle."""
    stack = [(lo, hi)]
    while stack:
        a, b = stack.pop()
        span = ends[b - 1] - starts[a]
        if span <= limit or b - a == 1:
            yield a, b
            continue
        middle2 = 2 * starts[a] + span
        cut = min(range(a, b - 1), key=lambda i: abs(2 * ends[i] - middle2)) + 1
        stack += [(cut, b), (a, cut)]


def split_units(
    df: DataFrame,
    keys: list[str] = ["device_id"],
    ident: str = "segment_id",
    max_gap_s: float = 2.5,
    max_unit_s: float = 20.0,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """Merged units no longer than ``max_unit_s``.

    A long unit of several rows is cut at the gap that starts nearest its middle (the first on
    ties), again until every part fits; a single long row is cut into even pieces. Only long units
    leave the JVM. A unit without any gap longer than ``max_gap_s`` is bounded by how long someone
    can speak without a pause, so each group stays small.
    """
    limit = to_us(max_unit_s)
    unit = [*keys, "session_start_us", "session_first"]
    rows = gap_sessions(df, keys, ident, max_gap_s, slot_us).select(
        *unit, "start_us", "end_us", F.col(ident).alias("_id")
    )
    last = F.max_by("end_us", F.struct("start_us", "_id")).over(Window.partitionBy(*unit))
    rows = rows.withColumn("_u_end", last)
    fits = F.col("_u_end") - F.col("session_start_us") <= limit
    short = rows.filter(fits).groupBy(*unit).agg(
        F.first("_u_end").alias("end_us"), F.count("*").alias("merge_count")
    ).select(
        *keys,
        F.col("session_first").alias("unit_id"),
        F.lit(0).cast("bigint").alias("part_no"),
        F.col("session_start_us").alias("start_us"),
        "end_us",
        "merge_count",
    )
    long_rows = rows.filter(~fits).drop("_u_end")
    schema = (
        ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
        + ", unit_id string, part_no bigint, start_us bigint, end_us bigint, merge_count bigint"
    )

    def cut(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_us", "_id"])
        s, e = pdf["start_us"].to_list(), pdf["end_us"].to_list()
        head = list(key[: len(keys)])
        out = [
            [*head, key[-1], n, s[a], e[b - 1], b - a]
            for n, (a, b) in enumerate(_bisect(s, e, 0, len(s), limit))
        ]
        return pd.DataFrame(out, columns=[*keys, "unit_id", "part_no", "start_us", "end_us", "merge_count"])

    parts = long_rows.groupBy(*unit).applyInPandas(cut, schema)
    pieces = split_interval(parts, max_unit_s).select(
        *keys,
        "unit_id",
        (F.col("part_no") * 1_000_000 + F.col("piece_no")).alias("part_no"),
        F.col("piece_start_us").alias("start_us"),
        F.col("piece_end_us").alias("end_us"),
        "merge_count",
    )
    return short.unionByName(pieces)


def preflag_source(unknown_ratio: Column, changes: Column, n: Column, participants: Column) -> Column:
    """``media_or_unknown`` for mostly unknown or rapidly alternating voices, else live."""
    rapid = (n >= 3) & (changes / n > 0.5)
    media = (
        (unknown_ratio >= 0.7)
        | (rapid & (unknown_ratio > 0.3))
        | ((F.size(participants) == 1) & F.array_contains(participants, "unknown"))
    )
    return F.when(media, "media_or_unknown").otherwise("live_conversation")


def speaker_changes(df: DataFrame, keys: list[str], ident: str, slot_us: int = SLOT_US) -> DataFrame:
    """Add ``prev_speaker`` in time order inside each key."""
    return running(
        df, keys, ["start_us", ident], {"prev_speaker": ("last", F.col("speaker"))}, slot_us=slot_us
    )


def group_conversations(
    df: DataFrame,
    keys: list[str] = ["device_id"],
    ident: str = "segment_id",
    max_gap_s: float = 90.0,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """Conversations between pauses above ``max_gap_s``, with speaker statistics and media flag.

    Everything is a mergeable aggregate, so a conversation of any length is combined map-side. The
    ordered text comes from ``operators.transcripts``.
    """
    rows = gap_sessions(df, keys, ident, max_gap_s, slot_us, ["speaker"])
    inside = F.col("session_first") != F.col(ident)
    conv = rows.groupBy(*keys, "session_start_us", "session_first").agg(
        F.max_by("end_us", F.struct("start_us", ident)).alias("end_us"),
        F.count("*").alias("n_segments"),
        F.sort_array(F.collect_set("speaker")).alias("participants"),
        F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias(
            "languages"
        ),
        F.sum((inside & (F.col("speaker") != F.col("prev_speaker"))).cast("bigint")).alias("changes"),
        F.avg((F.col("speaker") == "unknown").cast("double")).alias("unknown_ratio"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"),
    )
    return conv.select(
        *keys,
        F.col("session_first").alias("conversation"),
        F.col("session_start_us").alias("start_us"),
        "end_us",
        "n_segments",
        "participants",
        "languages",
        "changes",
        "unknown_ratio",
        "speech_us",
        ((F.col("n_segments") >= 3) & (F.col("changes") / F.col("n_segments") > 0.5)).alias("rapid"),
        preflag_source(
            F.col("unknown_ratio"), F.col("changes"), F.col("n_segments"), F.col("participants")
        ).alias("source_type"),
    )


def capped_sessions(
    df: DataFrame,
    keys: list[str] = ["device_id"],
    ident: str = "segment_id",
    max_gap_s: float = 12.0,
    max_length_s: float = 1800.0,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """Label rows with ``session_first`` under a gap limit, a day limit and a length cap.

    A row joins the session of the row with the greatest end so far, when both start on the same
    local date, the row starts 0 to ``max_gap_s`` after that end, and the session stays within
    ``max_length_s``. Of rows with equal ends the later one, by start and ``ident``, is the one to join. A row nested inside that earlier row stands alone and changes nothing for
    later rows. So all but the cap is a comparison with the greatest end, which cuts each key into
    runs natively. Only the cap is a fold, and it walks one run: rows of one device and day that do
    not overlap, which the length of a day bounds. Imported rows never join and never extend a
    session; each stands alone.
    """
    has_import = "imported" in df.columns
    live = df.filter(~F.col("imported")) if has_import else df
    cols = live.columns
    latest = F.struct(F.col("end_us").alias("e"), local_date(F.col("start_us")).alias("d"))
    rows = running(live, keys, ["start_us", ident], {"_prev": ("max", latest)}, slot_us=slot_us)
    gap = F.col("start_us") - F.col("_prev.e")
    nested = F.coalesce((gap < 0) & (F.col("end_us") < F.col("_prev.e")), F.lit(False))
    rows = rows.withColumn("_nested", nested).withColumn(
        "_opens",
        F.col("_prev").isNull()
        | (F.col("_prev.d") != local_date(F.col("start_us")))
        | (gap < 0)
        | (gap > to_us(max_gap_s)),
    )
    rows = assign_sessions(rows, keys, ident, F.col("_opens") & ~F.col("_nested"), slot_us)
    # A nested row is neither first of nor inside a run; it becomes a run of its own.
    rows = rows.select(
        *cols,
        F.when(F.col("_nested"), F.col("start_us")).otherwise(F.col("session_start_us")).alias("session_start_us"),
        F.when(F.col("_nested"), F.col(ident)).otherwise(F.col("session_first")).alias("session_first"),
    )
    run = [*keys, "session_start_us", "session_first"]
    cap = to_us(max_length_s)
    # Runs inside the cap need no fold and never leave the JVM.
    run_end = F.max("end_us").over(Window.partitionBy(*run))
    sized = rows.withColumn("_over", run_end - F.col("session_start_us") > cap)
    fine = sized.filter("NOT _over").drop("_over")
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*cols, "session_start_us", "session_first"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_us", ident])
        opened, first, s_out, f_out = None, None, [], []
        for s, e, i in zip(pdf["start_us"], pdf["end_us"], pdf[ident]):
            if opened is None or e - opened > cap:
                opened, first = s, i
            s_out.append(opened)
            f_out.append(first)
        return pdf.assign(session_start_us=s_out, session_first=f_out)[
            [*cols, "session_start_us", "session_first"]
        ]

    long_runs = sized.filter("_over").drop("_over").groupBy(*run).applyInPandas(fold, schema)
    out = fine.unionByName(long_runs)
    if has_import:
        single = df.filter(F.col("imported")).select(
            *cols, F.col("start_us").alias("session_start_us"), F.col(ident).alias("session_first")
        )
        out = out.unionByName(single)
    return out


def islands(df: DataFrame, keys: list[str], index: str, slot: int = 100_000) -> DataFrame:
    """Label runs of consecutive integers per key: rows of one run share ``island``."""
    one = {"_n": ("sum", F.lit(1).cast("bigint"))}
    out = running(df, keys, [index], one, slot_us=slot)
    return out.withColumn("island", F.col(index) - F.col("_n")).drop("_n")


def continuity_groups(
    df: DataFrame, keys: list[str], ident: str, tolerance_s: float = 0.025, slot_us: int = SLOT_US
) -> DataFrame:
    """Label chunk runs: a start further than the tolerance from the expected time opens a run."""
    rows = previous_end(df, keys, ident, slot_us=slot_us)
    off = F.abs(F.col("start_us") - F.col("prev_end"))
    return assign_sessions(
        rows, keys, ident, F.col("prev_end").isNull() | (off > to_us(tolerance_s)), slot_us
    )
