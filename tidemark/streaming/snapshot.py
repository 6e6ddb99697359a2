"""The daily snapshot as a stream over the observation log. The batch model stays the truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.latest import latest_known


def observations(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def daily_counts(log: DataFrame, at: str = "scraped_at", late: str = "2 days") -> DataFrame:
    """Observations by day and source; a day is final once the watermark has passed it."""
    return log.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), "source").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("date_key"), "source", "n")


def daily_snapshot(log: DataFrame, attributes: tuple[str, ...], at: str = "scraped_at", late: str = "2 days") -> DataFrame:
    """The newest known attributes by day and source posting."""
    grouped = log.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), "source", "source_job_id")
    return grouped.agg(*(latest_known(c, at).alias(c) for c in attributes)).select(F.to_date("w.start").alias("date_key"), "source", "source_job_id", *attributes)


def once_per_version(log: DataFrame, at: str = "scraped_at", late: str = "2 days") -> DataFrame:
    """The first observation of each content version within the watermark."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark(["source", "source_job_id", "content_hash"])


def into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a stream to its end, batch by batch; ``write`` must be idempotent by batch id."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
