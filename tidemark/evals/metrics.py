"""Classifier metrics over (truth, pred), and agreement of two signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import VISA_STATUSES


def confusion(pairs: DataFrame, labels: tuple[str, ...] = VISA_STATUSES) -> DataFrame:
    """Dense counts, one row per true label and a column per predicted one."""
    rows = pairs.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    counted = pairs.groupBy("truth").pivot("pred", list(labels)).agg(F.count(F.lit(1)))
    return rows.join(counted, "truth", "left").na.fill(0)


def class_metrics(pairs: DataFrame, labels: tuple[str, ...] = VISA_STATUSES) -> DataFrame:
    """label, support, predicted, tp, precision, recall, f1. Zero where a denominator is."""
    rows = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    # Each pair counts once for its truth and once for its prediction: one shuffle, no join of the two.
    sides = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("tp"))
    joined = rows.join(sums, "label", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = joined.withColumn("precision", ratio("tp", "predicted")).withColumn("recall", ratio("tp", "support"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def macro(per_class: DataFrame) -> DataFrame:
    """Means over the classes that occur, and accuracy."""
    found = per_class.where("support > 0")
    return found.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"))


def agreement(signals: DataFrame) -> DataFrame:
    """Of boolean a and b: counts, raw agreement, and the share of each that the other confirms (null if none)."""
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    n = lambda c: F.count_if(c)
    r = lambda x: F.bround(x, 4)
    return signals.agg(
        F.count("*").alias("n"), n(a).alias("a_positive"), n(b).alias("b_positive"), n(a & b).alias("both"), r(F.try_divide(n(a == b), F.count("*"))).alias("raw_agreement"),
        r(F.try_divide(n(a & b), n(a))).alias("b_given_a"), r(F.try_divide(n(a & b), n(b))).alias("a_given_b"),
    )


def thresholds_missed(per_class: list[dict], overall: dict, floors: dict[str, float]) -> list[str]:
    """What lies under its floor. Keys name a figure, or class.figure; classes that don't occur and keys that start with _ are left out."""
    classes = {c["label"]: c for c in per_class}
    out = []
    for key, floor in floors.items():
        if key.startswith("_"):
            continue
        label, dot, figure = key.rpartition(".")
        if dot:
            if not classes.get(label, {}).get("support"):
                continue
            value = classes[label][figure]
        else:
            value = overall[key]
        if value < floor:
            out.append(f"{key}: {value:.4f} < {floor}")
    return out
