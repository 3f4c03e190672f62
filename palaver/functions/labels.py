"""Reading label answers of a model, with rule labels where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL_SCHEMA = (
    "source_type string, is_pair boolean, quality string, participants array<string>, "
    "summary string, confidence_note string"
)


def json_object(raw: Column) -> Column:
    """Text from the first opening to the last closing brace."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def parse_label(raw: Column, preflag: Column) -> Column:
    """Struct of labels from an answer; missing fields get defaults, no object gives null."""
    p = F.from_json(json_object(raw), LABEL_SCHEMA)
    return F.when(
        json_object(raw) != "",
        F.struct(
            F.coalesce(p["source_type"], preflag).alias("source_type"),
            F.coalesce(p["is_pair"], F.lit(False)).alias("is_pair"),
            F.coalesce(p["quality"], F.lit("neutral")).alias("quality"),
            F.coalesce(p["summary"], F.lit("")).alias("summary"),
        ),
    )


def fallback_label(preflag: Column, participants: Column, owner="owner", partner="partner") -> Column:
    """Labels by rule: the media flag, both named speakers present, quality not applicable."""
    return F.struct(
        preflag.alias("source_type"),
        (F.array_contains(participants, owner) & F.array_contains(participants, partner)).alias("is_pair"),
        F.lit("not_applicable").alias("quality"),
        F.lit("").alias("summary"),
    )
