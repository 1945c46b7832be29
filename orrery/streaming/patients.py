"""Extension: counts of both arms by patient, kept up to date over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arm_counts(events: DataFrame, patient: str, time: str, is_a: Column, is_b: Column, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """patient, window, n_a, n_b by event-time windows; what comes later than `late` is left out of streams. Batches give the same."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("window"), F.col(patient).alias("patient")).agg(F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b")).select("patient", F.col("window.start").alias("start"), "n_a", "n_b")


def from_parquet(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
