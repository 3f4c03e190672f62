"""Explicit table schemas, and alignment of older tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONVERSATIONS = (
    "conversation_id bigint, date string, start_time string, end_time string, "
    "duration_seconds double, participants array<string>, source_type string, "
    "is_pair boolean, quality string, languages array<string>, summary string, "
    "transcript string, raw_transcript string, cleaned_transcript string, slug string"
)
JOURNAL_SEGMENTS = (
    "id string, conversation_id bigint, start_us bigint, end_us bigint, text_raw string, "
    "raw_json string, engine string, model string, status string, language string, "
    "imported boolean, speaker_id string, speaker_similarity double"
)
STAGED = (
    "segment_id string, start_time string, end_time string, audio_path string, sample_rate int, "
    "duration_seconds double, captured_at string, core_start_samples bigint, "
    "core_end_samples bigint, format string"
)
JSONL_SEGMENT = (
    "start_time string, end_time string, text string, language string, confidence double, "
    "audio_path string"
)
IMPORT_CSV = (
    "date string, start_time string, end_time string, text string, language string, "
    "speaker string, engine string"
)
SEGMENTS = (
    "segment_id string, device_id string, start_us bigint, end_us bigint, speaker string, "
    "language string"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def align(df: DataFrame, ddl: str, backfill: dict[str, str] | None = None) -> DataFrame:
    """Give ``df`` exactly the columns of ``ddl``.

    Missing columns become typed nulls. ``backfill`` maps a column to the one that fills its nulls.
    """
    have = set(df.columns)
    wanted = struct_of(ddl)
    out = df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted
        ]
    )
    for target, source in (backfill or {}).items():
        out = out.withColumn(target, F.coalesce(F.col(target), F.col(source)))
    return out
