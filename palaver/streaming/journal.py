"""The live journal: repeats dropped, rows assessed, conversations assigned, one idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions.idents import hash_id48
from palaver.functions.quality import low_confidence
from palaver.operators.voices import best_and_second, decide, enabled
from palaver.streaming.flows import dedupe_stream
from palaver.streaming.runtime import EndMarks, run_batches
from palaver.streaming.stateful import capped_session_stream


def gate(stream: DataFrame, profiles: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Rows whose ``embedding`` matches one enabled voice, with its name as ``speaker``.

    Voices and their decision are per row, so the gate adds no state to the stream.
    """
    decided = decide(best_and_second(stream, enabled(profiles), "segment_id"), threshold, margin)
    kept = decided.filter(F.col("reason") == "matched")
    return kept.drop("best_name", "best", "second", "reason")


def live_journal(
    stream: DataFrame,
    gap_s: float = 12.0,
    cap_s: float = 1800.0,
    profiles: DataFrame | None = None,
    threshold: float = 0.80,
    margin: float = 0.08,
    marks: EndMarks | None = None,
) -> str:
    """Run the journal over all available input; returns the folder of the stored segments.

    A row is stored when the watermark has passed it; ``marks`` brings out the newest ones as well.

    With ``profiles`` only rows of enrolled voices go on. The verdict travels inside the row id
    through the session state, which keeps that state small.
    """
    if profiles is not None:
        stream = gate(stream, profiles, threshold, margin)
    if marks is not None:
        stream = marks.join(stream)
    low = low_confidence(F.col("no_speech_prob"), F.col("avg_logprob"))
    rows = dedupe_stream(stream).select(
        "device_id",
        F.concat_ws("|", "segment_id", F.when(low, "low_confidence").otherwise("ok")).alias("segment_id"),
        "start_us",
        "end_us",
        "event_time",
    )
    labelled = capped_session_stream(rows, gap_s, cap_s, delay=None)

    def sink(batch: DataFrame, n: int, base: str) -> None:
        own = F.split_part("segment_id", F.lit("|"), F.lit(1))
        batch.select(
            "device_id",
            own.alias("segment_id"),
            hash_id48(F.split_part("session_first", F.lit("|"), F.lit(1))).alias("conversation_id"),
            F.split_part("segment_id", F.lit("|"), F.lit(2)).alias("status"),
        ).write.mode("overwrite").parquet(f"{base}/table/batch={n}")

    base = run_batches(labelled, "journal", sink, marks=marks)
    return f"{base}/table/*"
