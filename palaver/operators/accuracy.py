"""Accuracy of recognisers against reference texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.editdist import char_edits, edit_ops
from palaver.functions.evaltext import error_rate
from palaver.functions.quality import repetition_loop
from palaver.functions.text import word_count


def rtf(processing: Column, audio: Column) -> Column:
    return F.when(audio > 0, processing / audio).otherwise(0.0)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """WER and CER per (scenario, system), with the split of the word edits, over whole texts.

    Columns that are not read later cost nothing: word and character edits are functions of their own.
    """
    r, h = F.col("reference"), F.col("hypothesis")
    rows = pairs.withColumns({"_o": edit_ops(r, h), "_c": char_edits(r, h)})
    rows = rows.withColumns({c: F.col(f"_o.{c}").cast("bigint") for c in ("ref_words", "hyp_words")})
    return rows.withColumns(
        {
            "substitutions": F.col("_o.sub").cast("bigint"),
            "deletions": F.col("_o.dele").cast("bigint"),
            "insertions": F.col("_o.ins").cast("bigint"),
            "wer": error_rate(F.col("_o.distance"), F.col("ref_words"), F.col("hyp_words")),
            "cer": error_rate(F.col("_c.distance"), F.col("_c.ref_chars"), F.col("_c.hyp_chars")),
        }
    ).drop("_o", "_c")


def ranking(scores: DataFrame) -> DataFrame:
    """Means per system. The report orders them by mean WER."""
    return scores.groupBy("system").agg(
        F.avg("wer").alias("mean_wer"), F.avg("cer").alias("mean_cer"), F.count("*").alias("scenarios")
    )


def best_per_scenario(scores: DataFrame) -> DataFrame:
    """System with the lowest WER per scenario, by name on ties."""
    w = Window.partitionBy("scenario").orderBy("wer", "system")
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def repetition_segments(df: DataFrame, key: list[str], text: str, compression: str | None = None) -> DataFrame:
    """Segments per key that loop, by the evaluation threshold."""
    c = None if compression is None else F.col(compression)
    hit = repetition_loop(F.col(text), 0.3, c if c is not None else F.lit(0.0))
    return df.groupBy(*key).agg(F.count_if(hit).alias("repetition_segments"))


def hallucinated_words(df: DataFrame, key: list[str], text: str, silent: Column) -> DataFrame:
    """Words put out where nothing was said."""
    return df.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(silent, word_count(F.col(text)))), F.lit(0)).alias("hallucinated_words")
    )


def compare_models(df: DataFrame, clip: str, model: str, text: str, models: list[str], order: str) -> DataFrame:
    """Texts of each model side by side per clip, segments joined by bars.

    The list of models is given, so the pivot needs no extra pass to find it.
    """
    item = F.struct(order, text)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x[text]), " | ")
    return df.groupBy(clip).pivot(model, models).agg(joined)


#: Columns of a report in order, and the digits of those that are fractions.
REPORT = {
    "scenario": None, "system": None, "wer": 4, "cer": 4, "insertions": None, "deletions": None, "substitutions": None,
    "ref_words": None, "hyp_words": None, "rtf": 3, "processing_time": 2, "audio_duration": 2,
    "repetition_segments": None, "hallucinated_words": None, "num_segments": None,
}


def segment_counts(segments: DataFrame, key: list[str], silent: str = "SILENCE") -> DataFrame:
    """Segments, looping segments, and the words put out in the scenario where nothing is said, per key."""
    words = F.when(F.col("scenario") == silent, word_count(F.col("text"))).otherwise(0)
    loops = repetition_loop(F.col("text"), 0.3, F.col("compression_ratio"))
    return segments.groupBy(*key).agg(
        F.count("*").alias("num_segments"),
        F.count_if(loops).alias("repetition_segments"),
        F.sum(words).cast("bigint").alias("hallucinated_words"),
    )


def full_report(scores: DataFrame, segments: DataFrame, times: DataFrame, silent: str = "SILENCE") -> DataFrame:
    """All columns of a report as text: scores, counts of segments, and times per (scenario, system).

    ``segments``: scenario, system, text, compression_ratio. ``times``: scenario, system, processing_time,
    audio_duration. A pair without segments has zeros.
    """
    key = ["scenario", "system"]
    rows = scores.join(times, key, "left").join(segment_counts(segments, key, silent), key, "left")
    rows = rows.withColumn("rtf", rtf(F.col("processing_time"), F.col("audio_duration")))
    return report(rows.fillna(0, ["num_segments", "repetition_segments", "hallucinated_words"])).select(*REPORT)


def report(scores: DataFrame) -> DataFrame:
    """Metric columns as fixed-decimal text; halves are rounded to even, as the exact binary value says."""

    def fixed(c: str, digits: int):
        return F.call_function("format_number", F.col(c), F.lit("0." + "0" * digits)).alias(c)

    return scores.select(*[fixed(c, REPORT[c]) if REPORT.get(c) else F.col(c) for c in scores.columns])
