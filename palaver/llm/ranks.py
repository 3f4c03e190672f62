"""Numbers of rows in a sorted order, without one task for a large group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.scratch import staged

#: Rows of a side table up to which it is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted into range partitions, with ``row``, a number that rises in this order, and ``chunk``.

    Both hold for one run of the plan, so it must be written before they are used twice. Equal rows are dealt
    out by where they were read.
    """
    tie = F.monotonically_increasing_id()
    ranged = df.withColumn("row", tie).repartitionByRange(*order, "row").sortWithinPartitions(*order, "row")
    return ranged.withColumn("row", tie).withColumn("chunk", F.shiftright("row", 33))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its group from 0, and ``size``, the rows of the group.

    Rows are sorted in range partitions; a group may lie in many of them. Only counts by group and partition
    are summed in order. Null is a group, and sorts first.
    """
    rows = staged(in_chunks(df, [*group, *order]))
    parts = rows.groupBy(*group, "chunk").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    before = F.sum("n").over(whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(
        *(F.col(g).alias(f"_{g}") for g in group),
        F.col("chunk").alias("_chunk"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("chunk") == F.col("_chunk")]
    found = rows.join(bounded(staged(shifts)), reduce(lambda a, b: a & b, same))
    return found.select(*df.columns, (F.col("row") + F.col("shift")).alias("pos"), "size")
