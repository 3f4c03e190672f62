"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.evaltext import normalize_text
from palaver.functions.idents import hash_id48
from palaver.functions.timefmt import local_date
from palaver.operators import accuracy as C
from palaver.operators import activity as A
from palaver.operators import glossary as G
from palaver.operators import sessions as S
from palaver.sources.tables import insert_new, mark_processed

CONVERSATION_ROWS = (
    "conversation_id bigint, device_id string, first_segment string, start_us bigint, end_us bigint, "
    "n_segments bigint, source_type string, unknown_ratio double, date string"
)


def batch_conversations(
    spark: SparkSession, staged: DataFrame, table: str, at_us: int, max_gap_s: float = 90.0
) -> tuple[DataFrame, DataFrame]:
    """Group pending segments, commit the conversations, and acknowledge what was committed.

    The id is the hash of the first segment, so a repeated run inserts nothing. Segments are
    acknowledged only through conversations read back from the table.
    """
    todo = staged.filter(F.col("processed_us").isNull())
    rows = S.gap_sessions(todo, ["device_id"], "segment_id", max_gap_s)
    conv = S.group_conversations(todo, max_gap_s=max_gap_s).select(
        hash_id48(F.col("conversation")).alias("conversation_id"),
        "device_id",
        F.col("conversation").alias("first_segment"),
        "start_us",
        "end_us",
        "n_segments",
        "source_type",
        "unknown_ratio",
        local_date(F.col("start_us")).alias("date"),
    )
    stored = insert_new(spark, table, conv, "conversation_id", CONVERSATION_ROWS)
    done = rows.join(
        stored.select(F.col("first_segment").alias("session_first")), "session_first", "left_semi"
    )
    return stored, mark_processed(staged, done, F.lit(at_us))


def glossary_weekly(conv: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recurrent new terms join the glossary, known ones get their counts; also the step counts."""
    candidates = G.candidate_terms(G.term_occurrences(conv))
    recurrent = G.recurrent(candidates)
    merged = G.merge_candidates(recurrent)
    known = glossary.select("term_key")
    new = merged.join(known, "term_key", "left_anti")
    updated = G.update_counts(glossary, merged)
    both = updated.unionByName(new.select(*glossary.columns))
    steps = candidates.select("term_key", F.lit("extracted").alias("step")).unionByName(
        recurrent.select("term_key", F.lit("recurrent").alias("step"))
    ).unionByName(new.select("term_key", F.lit("added").alias("step")))
    return both, steps.groupBy("step").agg(F.count("*").alias("n"))


def accuracy_report(pairs: DataFrame) -> DataFrame:
    """Normalise both sides, score every pair and give one report row each."""
    norm = pairs.select(
        "scenario",
        "system",
        normalize_text(F.col("reference")).alias("reference"),
        normalize_text(F.col("hypothesis")).alias("hypothesis"),
    )
    return C.score_pairs(norm).drop("reference", "hypothesis")


def dashboard(conv: DataFrame, staged: DataFrame, date: str, as_of: str) -> DataFrame:
    """The figures of the overview as (panel, metric, value) rows."""

    def long(df: DataFrame, panel: str) -> DataFrame:
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        return wide.unpivot([], df.columns, "metric", "value").withColumn("panel", F.lit(panel))

    quality = A.quality_distribution(conv).select(
        F.col("quality").alias("metric"), F.col("n").cast("double").alias("value"), F.lit("quality").alias("panel")
    )
    backlog = A.backlog_status(staged).select("total_hours", "segment_count")
    return (
        long(A.daily_stats(conv, date), "day")
        .unionByName(long(A.pair_stats(conv, as_of), "pair"))
        .unionByName(quality)
        .unionByName(long(backlog, "backlog"))
    )
