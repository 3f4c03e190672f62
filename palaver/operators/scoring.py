"""Quality scores of transcript rows and counters over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import quality as Q
from palaver.functions.text import let, words


def score_texts(
    df: DataFrame,
    text: str = "text",
    n_words: str = "word_count",
    confidence: str = "confidence",
    low: str = "low_confidence",
    times: int = 3,
) -> DataFrame:
    """Add quality flags, reason and score.

    The expensive repetition tests are columns of their own, so each runs once per row, and only on
    rows that the cheap tests before them passed.
    """
    n = F.col(n_words)
    rows = df.withColumn("_norm", Q.normal(F.col(text)))
    rows = rows.withColumns(
        {"_leak": Q.contains_any(F.col("_norm"), Q.PROMPT_PATTERNS), "_ends": Q.media_artifact(F.col("_norm"))}
    )
    rows = rows.withColumn("_clean", ~F.col("_leak") & ~F.col("_ends") & (n >= 3))
    rows = rows.withColumn("_word", F.when(F.col("_clean"), Q.repetitive_word(F.col("_norm"), times)))
    rows = rows.withColumn(
        "_phrase",
        F.when(F.col("_clean") & F.col("_word").isNull(), Q.repetitive_phrase(F.col("_norm"), times)),
    )
    word, phrase = F.col("_word"), F.col("_phrase")
    media = ~F.col("_leak") & F.col("_ends")
    rep = word.isNotNull() | phrase.isNotNull()
    rows = rows.withColumns(
        {
            "is_prompt_leak": F.col("_leak"),
            "is_media_artifact": media,
            "is_repetitive": rep,
            "is_too_short": ~F.col("_leak")
            & ~F.col("_ends")
            & ~rep
            & Q.too_short_filler(F.col("_norm"), n),
            "_low_short": F.col(low) & (n < 5),
        }
    )
    same = let(word, lambda r: F.size(F.filter(words(F.col("_norm")), lambda w: w == r)))
    reason = F.array_join(
        F.array(
            F.when(F.col("_leak"), "prompt_leak"),
            F.when(media, "media_artifact"),
            F.when(
                media & (n <= 2) & F.col("_norm").isin(list(Q.MEDIA_SIGNATURES)), "short_media_phrase"
            ),
            F.when(word.isNotNull(), F.format_string("repetitive(%sx%d)", word, same)),
            F.when(
                phrase.isNotNull(),
                F.format_string("phrase_repetition(%sx%d)", phrase, Q.occurrences(F.col("_norm"), phrase)),
            ),
            F.when(F.col("is_too_short"), "too_short_filler"),
            F.when(F.col("_low_short"), "low_confidence_short"),
        ),
        "; ",
    )
    penalty = (
        F.when(F.col(low), 0.3).otherwise(0.0)
        + F.when(n < 3, 0.2).otherwise(0.0)
        + F.when(F.col(confidence) < 0.8, 0.2).otherwise(0.0)
    )
    garbage = F.col("_leak") | media | rep | F.col("is_too_short") | F.col("_low_short")
    rows = rows.withColumn("is_garbage", garbage).withColumn("reason", reason)
    return rows.withColumns(
        {
            "score": F.when(F.col("is_garbage"), 0.0).otherwise(
                F.greatest(F.lit(0.0), F.lit(1.0) - penalty)
            ),
            "reason": F.when(F.col("reason") == "", "ok").otherwise(F.col("reason")),
        }
    ).drop("_norm", "_leak", "_ends", "_clean", "_word", "_phrase", "_low_short")


def filter_conversations(scored: DataFrame, key: str, discard_at: float = 0.7) -> DataFrame:
    """Garbage share per conversation, its score, and whether to drop the conversation."""
    g = scored.groupBy(key).agg(
        F.avg(F.col("is_garbage").cast("double")).alias("garbage_fraction"),
        F.bool_or("is_media_artifact").alias("any_media"),
    )
    share = F.col("garbage_fraction")
    return g.select(key, share, (1 - share).alias("score"), (share >= discard_at).alias("discard"), "any_media")


def good_rows(scored: DataFrame) -> DataFrame:
    return scored.filter(~F.col("is_garbage"))


def filter_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("segments_processed"),
        F.count_if("is_garbage").alias("segments_filtered"),
        F.count_if("is_media_artifact").alias("media_artifacts"),
        F.count_if("is_prompt_leak").alias("prompt_leaks"),
        F.count_if("is_repetitive").alias("repetitive"),
    )
