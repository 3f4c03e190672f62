"""Idempotent writes to stored tables of Parquet files partitioned by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_new(spark: SparkSession, path: str, rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Append the rows whose key the table does not hold; returns the table as it is afterwards.

    Running it again with the same rows adds nothing.
    """
    try:
        known = spark.read.schema(schema).parquet(path).select(key)
        rows = rows.join(known, key, "left_anti")
    except Exception as e:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.dropDuplicates([key]).write.mode("append").partitionBy("date").parquet(path)
    return spark.read.schema(schema).parquet(path)


DAILY = "speech_us bigint, segment_count bigint, first_us bigint, last_us bigint, date string"
_COUNTED = "segment_id string, start_us bigint, end_us bigint, date string"


def upsert_daily(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Add a batch of segments to the daily totals and rewrite only the dates it touches.

    The segments counted so far lie beside the totals, by date. A batch that comes again adds none, and the
    touched dates are computed anew from them, so the totals stay the same.
    """
    counted = insert_new(
        spark, f"{path.rstrip('/')}__segments", rows.select("segment_id", "start_us", "end_us", "date"), "segment_id", _COUNTED
    )
    order = F.struct("start_us", "segment_id")
    totals = (
        counted.join(rows.select("date").distinct(), "date", "left_semi")
        .groupBy("date")
        .agg(
            F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"),
            F.count("*").alias("segment_count"),
            F.min_by("start_us", order).alias("first_us"),
            F.max_by("end_us", order).alias("last_us"),
        )
    )
    (
        totals.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )
    return spark.read.schema(DAILY).parquet(path)


def mark_processed(staged: DataFrame, acks: DataFrame, at: Column, key: str = "segment_id") -> DataFrame:
    """Set the processed time of acknowledged rows that have none yet."""
    ids = acks.select(key).distinct().withColumn("_ack", F.lit(True))
    return (
        staged.join(ids, key, "left")
        .withColumn("processed_us", F.coalesce("processed_us", F.when(F.col("_ack"), at)))
        .drop("_ack")
    )


def source_decision(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decision of each member's source, the part of the id before the double underscore."""
    source = F.split_part("segment_id", F.lit("__"), F.lit(1))
    first = (
        members.withColumn("source_id", source)
        .groupBy("conversation_id", "source_id")
        .agg(F.min("start_us").alias("start_us"))
    )
    return first.join(decisions, "source_id")


def legacy_asset(conversations: DataFrame, assets: DataFrame) -> DataFrame:
    """Cached asset of a conversation by date and the id at the end of the file name."""
    ids = (
        assets.withColumn("conversation_id", F.regexp_extract("name", r"-(\d+)\.ogg$", 1).try_cast("bigint"))
        .filter(F.col("conversation_id").isNotNull())
        .groupBy("date", "conversation_id")
        .agg(F.min("name").alias("name"))
    )
    return conversations.join(ids, ["date", "conversation_id"], "left")
