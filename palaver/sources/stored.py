"""Tables that change by key: touched buckets are written anew, and one rename makes a version visible.

A version is a small table that names, for each bucket, the folder that holds its rows. Buckets without a change
keep the folder of an earlier version. A write that fails before the rename leaves nothing that a reader sees;
two writers of one version cannot both succeed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class StoredTable:
    """Rows of ``schema`` by a unique ``key``, below ``folder``. A null key is equal to none, so such rows stay."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest version, 0 before the first."""
        place = self._path(f"{self.folder}/versions")
        if not self._files.exists(place):
            return 0
        return max((int(f.getPath().getName()) for f in self._files.listStatus(place)), default=0)

    def _places(self, version: int) -> dict[int, str]:
        """The folder that holds each bucket; there are at most as many as buckets."""
        if not version:
            return {}
        rows = self.spark.read.schema("bucket int, written string").parquet(f"{self.folder}/versions/{version}").collect()
        return {r.bucket: r.written for r in rows}

    def _rows(self, places: dict[int, str], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/data/{v}/bucket={b}" for b, v in places.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or an earlier version of it."""
        return self._rows(self._places(self.version() if version is None else version))

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    def _commit(self, changes: DataFrame, merged) -> int:
        """Write the buckets of the changed keys as ``merged(old rows, changes)`` and make them the new version.

        Changes that leave every touched bucket as it is make no version, so a repeat changes nothing.
        """
        before = self.version()
        places = self._places(before)
        touched = {r.bucket for r in changes.select(self._bucket(self.key)).distinct().collect()}
        if not touched:
            return before
        old = self._rows(places, touched)
        new = merged(old, changes).select(*old.columns)
        number = before + 1
        # No other writer of this version has the same name, so none can spoil what the other commits.
        name = f"{number}-{uuid.uuid4().hex}"
        target = f"{self.folder}/data/{name}"
        new.withColumn("bucket", self._bucket(self.key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(target)
        if _mark(written) == _mark(old):
            return before
        full = {r.bucket for r in written.select("bucket").distinct().collect()}
        places = {b: v for b, v in places.items() if b not in touched} | dict.fromkeys(full, name)
        draft = f"{self.folder}/drafts/{name}"
        rows = self.spark.createDataFrame(sorted(places.items()), "bucket int, written string")
        rows.coalesce(1).write.mode("overwrite").parquet(draft)
        self._files.mkdirs(self._path(f"{self.folder}/versions"))
        final = self._path(f"{self.folder}/versions/{number}")
        if self._files.exists(final) or not self._files.rename(self._path(draft), final):
            raise RuntimeError(f"version {number} of {self.folder} was written by someone else")
        return number

    def replace(self, rows: DataFrame) -> int:
        """Insert the rows; those with a known key take the place of the stored ones. Returns the version.

        ``rows`` has one row a key. Other stored rows stay.
        """
        return self._commit(rows, lambda old, new: old.join(new, self.key, "left_anti").unionByName(new.select(*old.columns)))

    def update(self, changes: DataFrame) -> tuple[int, DataFrame]:
        """Set columns of stored rows by key; returns the version and the keys that are not stored.

        ``changes`` has the key and the columns to set, one row a key; a null sets null.
        """
        columns = [c for c in changes.columns if c != self.key]
        before = self.version()
        known = self.read(before).select(self.key)
        absent = changes.select(self.key).join(known, self.key, "left_anti")

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            named = new.select(self.key, F.struct(*columns).alias("_new"))
            both = old.join(named, self.key, "left")
            return both.withColumns({c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")) for c in columns})

        return self._commit(changes.join(known, self.key, "left_semi"), merged), absent

    def remove(self, keys: DataFrame) -> int:
        """Drop the rows of these keys. Returns the version."""
        return self._commit(keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"))


def _mark(rows: DataFrame) -> tuple:
    """Count and order-free hashes of rows, to tell whether two tables are the same."""
    rows = rows.drop("bucket")
    columns = sorted(rows.columns)
    one, two = (F.sum(F.xxhash64(F.lit(i), *columns).cast("decimal(38,0)")) for i in (0, 1))
    return tuple(rows.agg(F.count("*"), one, two).first())
