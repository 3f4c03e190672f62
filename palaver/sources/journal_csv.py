"""Validated import of journal rows from CSV, and the export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.idents import csv_row_id, hash_id48
from palaver.functions.text import trim_ws
from palaver.functions.timefmt import JOURNAL_OFFSET_US, local_date, parse_canonical_date
from palaver.schemas import IMPORT_CSV

MAX_TEXT = 100_000
REQUIRED = ("date", "start_time", "end_time", "text")
_TIME = r"^\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?$"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by the names in the header; quoted line breaks are part of a field.

    Columns may stand in any order, and those that are not required may be missing: they are null. All
    files of one path share a header, since a quoted line break also makes each file one task.
    """
    rows = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("inferSchema", False)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    names = T.StructType.fromDDL(IMPORT_CSV).names
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names))


def _instant(date, time):
    at = F.concat_ws(" ", date, time).try_cast("timestamp")
    zoned = time.rlike(r"[+-]\d{2}:\d{2}$")
    # A time without an offset is local to the journal.
    us = F.unix_micros(at) - F.when(zoned, 0).otherwise(JOURNAL_OFFSET_US)
    return F.when(time.rlike(_TIME), us)


def checked(rows: DataFrame) -> DataFrame:
    """Add the instants and the list of ``violations`` of each row."""
    day = parse_canonical_date(F.col("date"))
    out = rows.withColumns(
        {
            "_day": day,
            "start_us": _instant(F.col("date"), F.col("start_time")),
            "end_us": _instant(F.col("date"), F.col("end_time")),
        }
    )
    text = F.coalesce("text", F.lit(""))
    day_text = F.col("_day").cast("string")
    rules = [
        ("date", F.col("_day").isNull()),
        ("start_time", F.col("start_us").isNull()),
        ("end_time", F.col("end_us").isNull()),
        ("order", F.col("end_us") < F.col("start_us")),
        ("blank_text", trim_ws(text) == ""),
        ("long_text", F.length(text) > MAX_TEXT),
        (
            "other_day",
            (local_date(F.col("start_us")) != day_text) | (local_date(F.col("end_us")) != day_text),
        ),
    ]
    bad = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules]))
    return out.withColumn("violations", bad).drop("_day")


def prepare(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Rows ready to append, or an error if any row is invalid: the import is all or nothing."""
    marked = checked(rows)
    n, bad = marked.agg(F.count("*"), F.count_if(F.size("violations") > 0)).first()
    if bad:
        raise ValueError(f"{bad} rows: use YYYY-MM-DD, valid same-day times and nonempty text")
    if max_rows is not None and n > max_rows:
        raise ValueError(f"at most {max_rows} rows")
    return with_ids(marked)


def iso_local(us):
    """Local time with its fixed offset, as stored ids spell it."""
    from palaver.functions.timefmt import DAY_US, local_time

    shifted = us + F.lit(JOURNAL_OFFSET_US)
    frac = F.pmod(F.pmod(shifted, F.lit(DAY_US)), F.lit(1_000_000))
    part = F.when(frac == 0, "").otherwise(F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0")))
    return F.concat(local_date(us), F.lit("T"), local_time(us), part, F.lit("+05:30"))


def with_ids(marked: DataFrame) -> DataFrame:
    speaker = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("unknown"))
    sid = csv_row_id(
        iso_local(F.col("start_us")),
        iso_local(F.col("end_us")),
        F.col("text"),
        F.col("speaker"),
        F.coalesce("language", F.lit("")),
    )
    out = marked.withColumn("id", sid).withColumn("conversation_id", hash_id48(F.col("id")))
    return out.select(
        "id",
        "conversation_id",
        "date",
        "start_us",
        "end_us",
        F.col("text").alias("text_raw"),
        speaker.alias("speaker"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.lit("imported").alias("engine"),
        F.lit("imported").alias("status"),
        F.lit(True).alias("imported"),
    ).dropDuplicates(["id"])


def split_new(ready: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet."""
    return ready.join(existing.select("id"), "id", "left_anti")


def export_rows(conversations: DataFrame, members: DataFrame) -> DataFrame:
    """Journal rows for export, with the first engine of each conversation or ``legacy``."""
    engine = members.groupBy("conversation_id").agg(
        F.min_by("engine", F.struct("start_us", "segment_id")).alias("engine")
    )
    return conversations.join(engine, "conversation_id", "left").select(
        "conversation_id",
        "date",
        "start_time",
        "end_time",
        F.coalesce(F.nullif("raw_transcript", F.lit("")), F.col("transcript"), F.lit("")).alias("text"),
        F.array_join("languages", ",").alias("language"),
        F.array_join("participants", ",").alias("speaker"),
        F.coalesce("engine", F.lit("legacy")).alias("engine"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows by date, start and id, every field quoted."""
    out = rows.orderBy("date", "start_time", "conversation_id").drop("conversation_id")
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)
