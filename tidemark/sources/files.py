"""Scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def raw_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.POSTINGS).parquet(path)


def raw_enrichment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENRICHMENT).parquet(path)


def register_seed(spark: SparkSession, path: str) -> DataFrame:
    """Text columns alone: leading zeros of numbers matter."""
    return spark.read.schema(schemas.REGISTER).option("header", True).csv(path)


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """A missing file is an error."""
    return spark.read.schema(schemas.GOLDEN).json(path)


def responses(spark: SparkSession, path: str) -> DataFrame:
    """A missing file is an empty table."""
    return spark.read.schema(schemas.RESPONSES).json(path) if exists(spark, path) else spark.createDataFrame([], schemas.RESPONSES)


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """(unique_id, status) of a run artifact."""
    return spark.read.schema(schemas.RUN_RESULTS).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def table_exists(spark: SparkSession, name: str) -> bool:
    """False only where the catalog answers that there is none; an unreachable catalog raises."""
    return spark.catalog.tableExists(name)
