"""Streaming jobs out of built-in operators: windows, sessions, de-duplication and keyed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.sources.files import CORRUPT, is_broken, pending, staged_schema
from palaver.streaming.runtime import END_US, WATERMARK, event_time, run_batches, upsert_partitions


def stage_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Staged metadata as it lands, oldest files first, a bounded number per trigger."""
    return (
        spark.readStream.schema(staged_schema())
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("latestFirst", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def timed(stream: DataFrame, us: str = "start_us", delay: str = WATERMARK) -> DataFrame:
    """``stream`` with a watermark on ``event_time``. End marks move the watermark and go no further."""
    marked = stream.withColumn("event_time", event_time(us)).withWatermark("event_time", delay)
    return marked.where(F.col("event_time") < F.timestamp_micros(F.lit(END_US)))


def dedupe_stream(stream: DataFrame, key: str = "segment_id", delay: str = WATERMARK) -> DataFrame:
    """Each id once among repeats that arrive within the watermark delay."""
    return timed(stream, delay=delay).dropDuplicatesWithinWatermark([key])


def session_stream(
    stream: DataFrame, key: str = "device_id", gap_s: float = 90.0, delay: str = WATERMARK
) -> DataFrame:
    """Gap sessions of intervals, closed by the watermark.

    Each row reaches from its start to its end plus the gap, and rows that touch merge, so a session
    follows the greatest end so far.
    """
    reach = F.concat(
        ((F.col("end_us") - F.col("start_us")) + int(gap_s * 1e6)).cast("string"), F.lit(" microseconds")
    )
    rows = timed(stream, delay=delay).withColumn("_reach", reach)
    return (
        rows.groupBy(key, F.session_window("event_time", F.col("_reach")).alias("w"))
        .agg(F.count("*").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
        .select(key, "start_us", "end_us", "n")
    )


def tumbling_activity(stream: DataFrame, key: str, width: str = "30 seconds", delay: str = WATERMARK) -> DataFrame:
    """Rows and speech per fixed window."""
    return (
        timed(stream, delay=delay)
        .groupBy(key, F.window("event_time", width).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"))
        .select(key, F.unix_micros("w.start").alias("window_us"), "n", "speech_us")
    )


def sliding_vote(
    stream: DataFrame, key: str, width: str = "2 seconds", hop: str = "1 second", delay: str = WATERMARK
) -> DataFrame:
    """Speaker of each sliding window when all its rows agree, else empty."""
    return (
        timed(stream, delay=delay)
        .groupBy(key, F.window("event_time", width, hop).alias("w"))
        .agg(F.min("speaker").alias("_a"), F.max("speaker").alias("_b"), F.count("*").alias("n"))
        .select(
            key,
            F.unix_micros("w.start").alias("window_us"),
            F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("").alias("speaker"),
            "n",
        )
    )


def daily_rollup_stream(stream: DataFrame) -> str:
    """Running totals per local date; each batch replaces the dates it changed. Returns the table."""
    totals = stream.groupBy("date").agg(
        F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"),
        F.count("*").alias("segment_count"),
        F.min("start_us").alias("first_us"),
        F.max_by("end_us", F.struct("start_us", "segment_id")).alias("last_us"),
    )

    def sink(batch: DataFrame, _n: int, base: str) -> None:
        upsert_partitions(batch, f"{base}/table", "date")

    return run_batches(totals, "daily-stream", sink, "update") + "/table"


#: Buckets of stored balances, and batches after which their versions are merged into one snapshot.
BUCKETS, COMPACT = 64, 16
BALANCE = "device_id string, waiting_us bigint, segment_count bigint, is_overflow boolean, growing boolean, bucket int"


def balances_before(spark: SparkSession, base: str, n: int) -> DataFrame:
    """Newest balance of each device from batches before ``n``: the last snapshot, and the versions after it.

    Which snapshot holds follows from ``n``, so a batch that is run again reads what it read at first.
    """
    upto = (n - 1) // COMPACT * COMPACT if n > 0 else 0
    versions = spark.createDataFrame([], f"{BALANCE}, batch int")
    if n > 0:
        stored = spark.read.schema(f"{BALANCE}, batch int").parquet(f"{base}/deltas")
        low = upto if upto else -1
        versions = stored.where((F.col("batch") > low) & (F.col("batch") < n))
    if upto:
        held = spark.read.schema(BALANCE).parquet(f"{base}/snapshots/upto={upto}")
        versions = versions.unionByName(held.withColumn("batch", F.lit(upto)))
    rest = [c for c in versions.columns if c not in ("device_id", "bucket")]
    newest = versions.groupBy("bucket", "device_id").agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return newest.select("device_id", "v.*", "bucket")


def store_balances(batch: DataFrame, n: int, base: str, overflow_hours: float = 8.0) -> None:
    """Store the balances that changed in batch ``n`` as its version. Repeating any batch changes nothing.

    A balance grows if it was positive before the batch and is greater after it. Each ``COMPACT`` batches all
    versions so far become one snapshot, so a batch reads one snapshot and a few versions, of its buckets only.
    """
    spark = batch.sparkSession
    rows = batch.withColumns(
        {
            "is_overflow": F.col("waiting_us") / 3.6e9 >= overflow_hours,
            "bucket": F.pmod(F.xxhash64("device_id"), F.lit(BUCKETS)).cast("int"),
        }
    )
    old = balances_before(spark, base, n).select("bucket", "device_id", F.col("waiting_us").alias("before"))
    grown = (F.col("before") > 0) & (F.col("waiting_us") > F.col("before"))
    rows = rows.join(old, ["bucket", "device_id"], "left").withColumn("growing", F.coalesce(grown, F.lit(False)))
    kept = rows.select("device_id", "waiting_us", "segment_count", "is_overflow", "growing", "bucket")
    kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/deltas/batch={n}")
    if n and n % COMPACT == 0:
        _with(spark, base, n).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/snapshots/upto={n}")


def _with(spark: SparkSession, base: str, n: int) -> DataFrame:
    """Balances after batch ``n``: those before it, replaced by its own version."""
    own = spark.read.schema(BALANCE).parquet(f"{base}/deltas/batch={n}")
    old = balances_before(spark, base, n).drop("batch").join(own, ["bucket", "device_id"], "left_anti")
    return old.unionByName(own)


def balances(spark: SparkSession, base: str, n: int) -> DataFrame:
    """The balances after batch ``n``."""
    return _with(spark, base, n).drop("bucket")


def backlog_stream(stream: DataFrame, overflow_hours: float = 8.0, base: str | None = None) -> str:
    """Unprocessed hours and rows per device from arrivals and acknowledgements, stored by batch.

    A batch compares each balance with the one stored before it; growth from a positive balance raises the
    flag. With ``base`` an earlier run goes on. Returns the folder, to be read with ``balances``.
    """
    span = F.col("end_us") - F.col("start_us")
    moves = F.array_compact(
        F.array(
            F.struct(span.alias("d"), F.lit(1).alias("n")),
            F.when(F.col("processed_us").isNotNull(), F.struct((-span).alias("d"), F.lit(-1).alias("n"))),
        )
    )
    balance = (
        stream.select("device_id", F.explode(moves).alias("m"))
        .groupBy("device_id")
        .agg(F.sum("m.d").alias("waiting_us"), F.sum("m.n").alias("segment_count"))
    )

    def sink(batch: DataFrame, n: int, folder: str) -> None:
        store_balances(batch, n, folder, overflow_hours)

    return run_batches(balance, "backlog-stream", sink, "update", base=base)


def live_updates(stream: DataFrame, summarise) -> str:
    """One summary row per batch that brought something. Repeating a batch rewrites its row."""

    def sink(batch: DataFrame, n: int, base: str) -> None:
        summarise(batch).withColumn("batch_id", F.lit(n)).write.mode("overwrite").parquet(
            f"{base}/table/batch={n}"
        )

    return run_batches(stream, "live", sink) + "/table"


def late_drop(stream: DataFrame, reset_us: int) -> str:
    """Rows after the reset go on, older ones to a side table. Returns the folder of both."""

    def sink(batch: DataFrame, n: int, base: str) -> None:
        late = F.col("start_us") <= reset_us
        batch.filter(~late).write.mode("overwrite").parquet(f"{base}/kept/batch={n}")
        batch.filter(late).write.mode("overwrite").parquet(f"{base}/late/batch={n}")

    return run_batches(stream, "late", sink)


def quarantine(staged: DataFrame) -> str:
    """Readable staged rows go on, broken ones are kept apart and counted."""

    def sink(batch: DataFrame, n: int, base: str) -> None:
        pending(batch).write.mode("overwrite").parquet(f"{base}/ready/batch={n}")
        batch.filter(is_broken()).select(CORRUPT, "segment_id").write.mode("overwrite").parquet(
            f"{base}/broken/batch={n}"
        )

    return run_batches(staged, "quarantine", sink)
