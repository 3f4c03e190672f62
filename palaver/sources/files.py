"""Readers and writers for segment files, staged metadata, day texts, notes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.ordered import running
from palaver.schemas import JSONL_SEGMENT, STAGED

CORRUPT = "_corrupt"


def scan_segments_jsonl(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Transcript lines below ``path/<date>/``; the date comes from the directory."""
    rows = spark.read.schema(JSONL_SEGMENT).json(f"{path}/{glob}")
    date = F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return rows.withColumn("date", date)


def staged_schema() -> str:
    return f"{STAGED}, {CORRUPT} string"


def scan_staged(spark: SparkSession, path: str) -> DataFrame:
    """Staged metadata, one JSON object per line, broken lines kept under ``_corrupt``."""
    return (
        spark.read.schema(staged_schema())
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def is_broken():
    return (
        F.col(CORRUPT).isNotNull()
        | F.col("segment_id").isNull()
        | F.coalesce(F.col("duration_seconds") < 0, F.lit(True))
    )


def pending(staged: DataFrame, limit: int | None = None) -> DataFrame:
    """Readable staged rows, oldest capture first, with default core offsets."""
    total = F.round(F.col("duration_seconds") * F.col("sample_rate")).cast("bigint")
    out = (
        staged.filter(~is_broken())
        .withColumn("core_start_samples", F.coalesce("core_start_samples", F.lit(0)))
        .withColumn("core_end_samples", F.coalesce("core_end_samples", total))
        .drop(CORRUPT)
    )
    return out if limit is None else out.orderBy("captured_at", "segment_id").limit(limit)


def corrupt_report(staged: DataFrame) -> DataFrame:
    """Readable and broken staged rows, the hours they hold, and whether someone should look."""
    bad = is_broken()
    return staged.agg(
        F.count_if(~bad).alias("valid"),
        F.count_if(bad).alias("invalid"),
        (F.coalesce(F.sum(F.when(~bad, F.col("duration_seconds"))), F.lit(0.0)) / 3600.0).alias("hours"),
    ).withColumn("status", F.when(F.col("invalid") > 0, "needs_attention").otherwise("operational"))


def write_day_texts(parts: DataFrame, path: str) -> None:
    """Day texts below ``date=<day>/``, one line per row of text."""
    parts.select("date", F.col("transcript").alias("value")).write.mode("overwrite").partitionBy(
        "date"
    ).text(path)


def write_texts(df: DataFrame, text: str, by: str, path: str) -> None:
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def layout_paths(df: DataFrame, path: str, ident: str, default: str) -> DataFrame:
    """Target directory and collision-free name for each source path.

    The directory is the first component that is a valid date, else ``default``. Later files of the
    same name in one directory get ``_1``, ``_2`` and so on, in the order of ``ident`` (a number).
    """
    parts = F.split(F.col(path), "/")
    valid = F.filter(
        parts, lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}$") & p.try_cast("date").isNotNull()
    )
    rows = df.withColumns(
        {"dir": F.coalesce(F.try_element_at(valid, F.lit(1)), F.lit(default)), "_name": F.element_at(parts, -1)}
    )
    one = {"_n": ("sum", F.lit(1).cast("bigint"))}
    rows = running(rows, ["dir", "_name"], [ident], one, slot_us=100_000)
    stem = F.regexp_replace("_name", r"\.[^.]*$", "")
    ext = F.regexp_extract("_name", r"(\.[^.]*)$", 1)
    name = F.when(F.col("_n") == 0, F.col("_name")).otherwise(
        F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext)
    )
    return rows.withColumn("name", name).drop("_n", "_name")


def write_report(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)
