"""Trailing request and second quotas without one task per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.timefmt import floor_div
from palaver.operators.ordered import running

HOUR_US = 3_600_000_000


def rolling_quota(
    usage: DataFrame,
    account: str = "account",
    ident: str = "request_id",
    per_minute: float = 20,
    hourly_seconds: float = 7200,
    daily_requests: float = 2000,
    daily_seconds: float = 28_800,
    fraction: float = 0.9,
) -> DataFrame:
    """Counts and seconds in the trailing minute, hour and local day before each request.

    A trailing hour lies in the hour of a request and the one before. Each row is copied into its
    own hour bucket and the next, the window runs inside a bucket, and only the original copies are
    kept. So a busy account is spread over its hours. The rows of a day are a running sum.
    Equal times count as earlier by id.
    """
    hour = floor_div(F.col("start_us"), HOUR_US)
    copies = usage.withColumn(
        "_b", F.explode(F.array(F.struct(hour.alias("h"), F.lit(True).alias("own")), F.struct((hour + 1).alias("h"), F.lit(False).alias("own"))))
    )
    rows = copies.select(*usage.columns, F.col("_b.h").alias("_h"), F.col("_b.own").alias("_own"))
    w = Window.partitionBy(account, "_h").orderBy("start_us")
    minute = w.rangeBetween(-60_000_000 + 1, 0)
    trailing = w.rangeBetween(-HOUR_US + 1, 0)
    near = (
        rows.withColumns(
            {
                "minute_count": F.count("*").over(minute) - 1,
                "hour_seconds": F.sum("billed_seconds").over(trailing) - F.col("billed_seconds"),
                "oldest_us": F.min("start_us").over(minute),
            }
        )
        .filter("_own")
        .drop("_h", "_own")
    )
    out = running(
        near,
        [account, "day"],
        ["start_us", ident],
        {"day_count": ("sum", F.lit(1).cast("bigint")), "day_seconds": ("sum", F.col("billed_seconds"))},
    )
    over = (
        (F.col("day_count") + 1 > daily_requests * fraction)
        | (F.col("day_seconds") + F.col("billed_seconds") > daily_seconds * fraction)
        | (F.col("hour_seconds") + F.col("billed_seconds") > hourly_seconds * fraction)
    )
    paced = F.col("minute_count") + 1 > per_minute * fraction
    wait = F.greatest(F.lit(1.0), F.lit(61.0) - (F.col("start_us") - F.col("oldest_us")) / 1e6)
    return out.withColumn(
        "verdict", F.when(over, "budget").when(paced, "paced").otherwise("admit")
    ).withColumn("retry_after", F.when(F.col("verdict") == "paced", wait).otherwise(0.0))
