"""Structured Streaming forms of gap groups, windows and incremental runs. The batch operators are their references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_batch: int = 1_000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(rows: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts (and sums of a value) by event-time window and keys; rows later than the watermark are left out."""
    measures = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    window = F.window(at, size, slide) if slide else F.window(at, size)
    grouped = rows.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(*measures)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def gap_sessions(rows: DataFrame, at: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions by key that end when nothing follows within the gap. A row exactly `gap` after the last one begins a new session, unlike the strict batch rule."""
    grouped = rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(rows: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(rows: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and reads its result.

    A complete result is replaced by each batch, an appended one has a folder for each batch; either way a batch that is
    run again changes nothing.
    """
    spark = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows").select(*rows.columns)


def incremental(rows: DataFrame, key: str, folder: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Applies `work` to rows whose key has no output yet: an anti-join with what is done, batch by batch."""
    spark = rows.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        try:
            done = spark.read.parquet(f"{folder}/done").select(key)
        except Exception as problem:  # nothing is done before the first batch
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            done = None
        new = batch if done is None else batch.join(done, key, "left_anti")
        work(new).write.mode("append").parquet(f"{folder}/done")

    query = rows.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
