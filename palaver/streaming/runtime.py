"""Running streams: sources over growing folders, one-shot runs, and keyed upsert sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import ROCKSDB, scratch_dir

WATERMARK = "10 minutes"
#: Time of an end mark, which no row reaches; the first instant of 2100.
END_US = 4_102_444_800_000_000


def prepare(spark: SparkSession) -> None:
    """Keep state on disk beside the executors, not on their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A Parquet table, a folder of files or one file, as a stream. The schema is read once.

    A table that is not there raises an error when the schema is read.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_time(us: str = "start_us"):
    return F.timestamp_micros(F.col(us))


class EndMarks:
    """Marks that end a stream: once all input is read, one mark moves the watermark past every row.

    So windows, waiting rows and open units come out, as when a recording is stopped. The mark itself is dropped
    behind the watermark (``flows.timed``). A stream that goes on later takes rows behind the mark as late.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_dir(spark, "marks")
        self._write(0)

    def _write(self, rows: int) -> None:
        marks = self.spark.range(rows).select(F.lit(END_US).alias("start_us"))
        marks.coalesce(1).write.mode("append").parquet(self.folder)

    def join(self, stream: DataFrame) -> DataFrame:
        marks = self.spark.readStream.schema("start_us bigint").parquet(self.folder)
        return stream.unionByName(marks, allowMissingColumns=True)

    def set(self) -> None:
        self._write(1)


def _to_end(writer, base: str, marks: EndMarks | None) -> None:
    """Run over all input; with ``marks`` once more, from the same checkpoint, when the mark is set."""
    for last in (False, True) if marks else (True,):
        q = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        q.start().awaitTermination()
        if marks and not last:
            marks.set()


def run_append(stream: DataFrame, purpose: str, mode: str = "append", marks: EndMarks | None = None) -> DataFrame:
    """Process all that is available into Parquet files and return them as a table."""
    spark = stream.sparkSession
    base = scratch_dir(spark, purpose)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
    _to_end(writer, base, marks)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(
    stream: DataFrame, purpose: str, sink, mode: str = "append", marks: EndMarks | None = None, base: str | None = None
) -> str:
    """Process all that is available through ``sink(batch, batch_id, folder)``; returns the folder.

    ``base`` is the folder of an earlier run, which then goes on with what is new.
    """
    base = base or scratch_dir(stream.sparkSession, purpose)
    _to_end(stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: sink(df, n, base)), base, marks)
    return base


def upsert_partitions(batch: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys in this batch. Repeating a batch changes nothing."""
    (
        batch.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )
