"""Streaming forms: daily cohort counts under a watermark, deduplication, and batch recomputation of touched months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_stream(spark, path: str, schema) -> DataFrame:
    """A stream over the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def daily_counts(stream: DataFrame, time: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Counts per day and key; a day is final once the watermark passes it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), *keys, "n")


def session_counts(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "n")


def first_deliveries(stream: DataFrame, time: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def months_of(days: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly counts from final daily counts."""
    return days.groupBy(F.trunc("day", "MM").alias("month"), *keys).agg(F.sum("n").alias("complaints"))


def run_to_table(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, appending final rows to a parquet table."""
    query = frame.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
