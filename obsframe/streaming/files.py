"""File streams: chunked filters, user callbacks per chunk, windowed sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path


def table_stream(spark: SparkSession, folder: str, table: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A parquet table of the folder as a file stream, a few files per micro-batch."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*").option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def text_stream(spark: SparkSession, folder: str, schema: StructType | str, sep: str = "\t", files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("header", True).option("sep", sep)
            .option("maxFilesPerTrigger", files_per_batch).csv(folder))


def run_to_table(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Run until the input is used up, appending to a table in the shared folder."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream")
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def filter_chunks(stream: DataFrame, keep: Column, out: str | None = None) -> DataFrame:
    """Chunk-at-a-time filter; equals the filter over the whole table."""
    return run_to_table(stream.where(keep), out)


def map_chunks(stream: DataFrame, fn: Callable[[DataFrame, int], DataFrame], out: str | None = None) -> DataFrame:
    """User callback ``fn(rows, chunk number)`` per chunk; its results are appended.

    Each chunk writes its own folder and replaces it, so a chunk that is run again after a
    failure does not appear twice.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "chunks")

    def handle(rows: DataFrame, number: int) -> None:
        fn(rows, number).write.mode("overwrite").parquet(f"{out}/chunk={number}")

    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", scratch_path(spark, "offsets"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)


def daily_sums(stream: DataFrame, ts: str, value: str, late: str | None = None, key: str | None = None) -> DataFrame:
    """Sum and row count per day, on a stream or a table.

    Without ``late`` every row counts, however late it comes. With it, a stream forgets days
    older than that, which bounds its state but leaves out rows that come later still.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if stream.isStreaming and late:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 day").alias("w"), *([key] if key else [])).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(
        F.to_date("w.start").alias("day"), *([key] if key else []), "total", "n")


def run_updates(stream: DataFrame, keys: list[str], out: str | None = None) -> DataFrame:
    """Run an aggregating stream in update mode; the result holds the last state of every key."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, "updates")

    def handle(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/chunk={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(handle)
             .option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start())
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct(*rest), "chunk").alias("r"))
    return last.select(*keys, "r.*")
