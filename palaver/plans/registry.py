"""Registry of runnable queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from palaver.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazily built input views over one folder of sample tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # The sample event times are naive and mean UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """The table, dealt out to all cores when it comes in fewer splits than there are cores.

        A large table has more splits than cores and is read as it lies, without a shuffle.
        """
        df = self.raw(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

    @cached_property
    def segments(self) -> DataFrame:
        return views.segments(self.raw("events"))

    @cached_property
    def turns(self) -> DataFrame:
        return views.turns(self.raw("conversations"))

    @cached_property
    def conv(self) -> DataFrame:
        return views.conv(self.turns)

    @cached_property
    def texts(self) -> DataFrame:
        return views.texts(self.spread("documents", "doc_id"))

    @cached_property
    def profiles(self) -> DataFrame:
        return views.profiles(self.raw("embeddings"))

    @cached_property
    def vectors(self) -> DataFrame:
        return views.vectors(self.raw("embeddings"))

    @cached_property
    def pairs(self) -> DataFrame:
        return views.pairs(self.spread("documents", "doc_id"))

    @cached_property
    def line_pairs(self) -> DataFrame:
        return views.line_pairs(self.spread("documents", "doc_id"))

    @cached_property
    def usage(self) -> DataFrame:
        return views.usage(self.segments)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is what DuckDB runs to check it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
