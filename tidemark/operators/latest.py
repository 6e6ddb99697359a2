"""Window and keyed operators that the models share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order given, which must be total. Plans as a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clusters(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The representative of each cluster, the first in the order given, with the cluster's size.

    Sizes are summed and first rows chosen before the shuffle, so that a cluster of any size sends
    a row for each task at most.
    """
    first = latest(df, [key], *order)
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("cluster_size"))
    return first.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def latest_known(value: Column | str, at: Column | str) -> Column:
    """The newest value that isn't null."""
    v, t = (F.col(c) if isinstance(c, str) else c for c in (value, at))
    return F.max_by(v, F.when(v.isNotNull(), t))


def top_k_rejoin(df: DataFrame, name: str, bucket: Column, k: int) -> DataFrame:
    """Counts by bucket of the k most frequent names."""
    top = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), name).limit(k).select(name)
    return df.join(F.broadcast(top), name).groupBy(name, bucket.alias("bucket")).agg(F.count("*").alias("n"))  # k rows at most


def pending(latest_versions: DataFrame, done: DataFrame, key: str, country: str, at: str, most: int, home: str = "NL") -> DataFrame:
    """Versions without a result, the home market first, then newest."""
    todo = latest_versions.join(done.select(key), key, "left_anti")
    return todo.orderBy(F.desc_nulls_last(F.col(country) == home), F.desc(at), key).limit(most)


def round_robin(df: DataFrame, strata: str | list[str], hashed: str, n: int) -> DataFrame:
    """n rows spread over strata: the first of each by hash, then the second of each, and so on. No row beyond the n-th of its stratum can be chosen, so it isn't shuffled."""
    by = [strata] if isinstance(strata, str) else list(strata)
    w = Window.partitionBy(*by).orderBy(hashed)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).orderBy("_i", *by, hashed).limit(n).drop("_i")
