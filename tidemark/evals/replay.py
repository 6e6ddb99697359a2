"""Scoring of recorded answers against a labelled set."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.evals import metrics


def drifted(golden: DataFrame) -> DataFrame:
    """Records whose text no longer has the digest it was labelled under; there should be none."""
    return golden.where(F.sha2("prompt_input", 256) != F.col("text_sha256"))


def scored_pairs(golden: DataFrame, responses: DataFrame) -> DataFrame:
    """(truth, pred) of the labelled records that an answer was recorded for."""
    labelled = golden.where("visa_status_true IS NOT NULL").select("content_hash", F.col("visa_status_true").alias("truth"))
    return labelled.join(responses.select("content_hash", F.col("response.visa.status").alias("pred")), "content_hash")


def skipped(golden: DataFrame, responses: DataFrame) -> DataFrame:
    return golden.where("visa_status_true IS NOT NULL").join(responses, "content_hash", "left_anti").select("content_hash")


def run(golden: DataFrame, responses: DataFrame, thresholds: dict[str, float]) -> dict:
    """The report of an eval: drifted records, scored and skipped ones, metrics, and thresholds that were missed.

    Without a scored pair there is ``nothing to score``, which is neither a pass nor a miss.
    """
    pairs = scored_pairs(golden, responses)
    by_class = [r.asDict() for r in metrics.class_metrics(pairs).collect()]  # a row for each class
    report = {"drifted": drifted(golden).count(), "scored": sum(r["support"] for r in by_class), "skipped": skipped(golden, responses).count()}
    if not report["scored"]:
        return report | {"outcome": "nothing to score", "classes": [], "overall": {}, "missed": []}
    overall = metrics.macro(metrics.class_metrics(pairs)).first().asDict()
    missed = metrics.thresholds_missed(by_class, overall, thresholds)
    return report | {"outcome": "missed" if missed or report["drifted"] else "passed", "classes": by_class, "overall": overall, "missed": missed}


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The report as one row of JSON."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "report string").coalesce(1).write.mode("overwrite").text(path)
