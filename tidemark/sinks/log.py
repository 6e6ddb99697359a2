"""Append-only log, table bootstrap, JSON lines and status files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas


def append_postings(df: DataFrame, path: str) -> int:
    """Adds observations, by day seen. Returns how many; an empty batch writes nothing."""
    n = df.count()
    if n:
        df.withColumn("scraped_date", F.to_date("scraped_at")).write.mode("append").partitionBy("scraped_date").parquet(path)
    return n


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.T.StructType([*schemas.POSTINGS.fields, schemas.T.StructField("scraped_date", schemas.T.DateType())])).parquet(path)


def flatten_enrichment(df: DataFrame) -> DataFrame:
    """The nested visa struct as columns, the whole response as JSON text."""
    visa = [F.col(f"visa.{f}").alias(f"visa_{f}") for f in ("status", "confidence", "evidence", "reasoning")]
    return df.select(*[c for c in df.columns if c != "visa"], *visa, F.to_json(F.struct(*df.columns)).alias("raw_response"))


def bootstrap(spark: SparkSession, statements: Iterable[str]) -> None:
    """Runs DDL texts in order: line comments go, statements end with semicolons."""
    for text in statements:
        bare = "\n".join(line.split("--")[0] for line in text.splitlines())
        for statement in filter(None, (s.strip() for s in bare.split(";"))):
            spark.sql(statement)


def materialise(df: DataFrame, name: str, view: bool = False) -> None:
    """Staging is views, everything after it tables."""
    df.createOrReplaceTempView(name) if view else df.write.mode("overwrite").saveAsTable(name)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_seed(df: DataFrame, path: str, refreshed_at: str, source_url: str) -> dict:
    """A register as CSV with header; returns what the sidecar file says."""
    df.select("organisation", "kvk_number").write.mode("overwrite").option("header", True).csv(path)
    return {"refreshed_at": refreshed_at, "row_count": df.count(), "source_url": source_url}


def run_summary(results: list[dict]) -> dict:
    """Counts of tests and models from (unique_id, status)."""
    tests = [r for r in results if r["unique_id"].startswith("test.")]
    models = [r for r in results if not r["unique_id"].startswith("test.")]
    good = lambda rows, ok: sum(r["status"] in ok for r in rows)
    return {"tests_total": len(tests), "tests_passed": good(tests, ("pass", "warn")), "models_total": len(models), "models_passed": good(models, ("success", "pass"))}


def failing_nodes(results: list[dict]) -> list[str]:
    return [r["unique_id"] for r in results if r["status"] in ("error", "fail", "runtime error")]


def public_status(fact: DataFrame, tests_defined: int, tests_passed: int, generated_at: str) -> dict:
    row = fact.agg(F.count("*").alias("n"), F.max("last_seen_at").cast("string").alias("newest")).first()
    return {"rows": row.n, "last_seen_at": row.newest, "tests_defined": tests_defined, "tests_passed": tests_passed, "generated_at": generated_at}


def changed(old: dict | None, new: dict) -> bool:
    """Whether anything but the time of writing differs."""
    bare = lambda d: {k: v for k, v in d.items() if k != "generated_at"}
    return old is None or bare(old) != bare(new)


def to_json(status: dict) -> str:
    return json.dumps(status, indent=2, sort_keys=True) + "\n"
