"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _large(links: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours, and itself, on the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Rows (u, v) for every node u but the smallest of its component, which is v. links: (u, v) in any order, without loops.

    Each round is written, so that neither a lineage nor a group of links is ever held by one task.
    """
    now = scratch.settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    step = 0
    while True:
        step += 1
        # A second of the two stars leads from a smaller node to larger ones only, so u > v holds throughout.
        now = scratch.settle(_small(_large(now)), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == mark:
            return now
        mark = after
