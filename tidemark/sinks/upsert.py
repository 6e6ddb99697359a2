"""Keyed upsert over Parquet: a new version is written beside the old one, then a pointer moves."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.latest import latest


def merged(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: new ones win over old, and among rows of one side the greatest by ``order``."""
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    return latest(both, keys, F.desc("_version"), *(F.desc(c) for c in order)).drop("_version")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class VersionedTable:
    """A table whose current rows are in the folder that the newest ``vN.done`` names. Readers never see half a write."""

    def __init__(self, spark: SparkSession, root: str, schema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def version(self) -> int:
        fs, root = _fs(self.spark, self.root)
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return max((int(n[1:].removesuffix(".done")) for n in names if n.endswith(".done")), default=0)

    def _folder(self, version: int) -> str:
        fs, mark = _fs(self.spark, f"{self.root}/v{version}.done")
        into = fs.open(mark)
        try:
            return f"{self.root}/{self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(into, 'UTF-8')}"
        finally:
            into.close()

    def read(self) -> DataFrame:
        return self._at(self.version())

    def _at(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._folder(version)) if version else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame, keys: list[str], *order: str) -> None:
        """Idempotent: the same rows again change nothing."""
        while True:
            now = self.version()
            name = f"v{now + 1}-{uuid.uuid4().hex}"
            before = self._at(now)
            merged(before, new.select(before.columns), keys, *order).write.parquet(f"{self.root}/{name}")
            # Only one writer can create a version's mark; whoever comes late merges again with what the other wrote.
            fs, mark = _fs(self.spark, f"{self.root}/v{now + 1}.done")
            try:
                out = fs.create(mark, False)
            except Py4JJavaError:
                if not fs.exists(mark):
                    raise
                continue
            out.write(bytearray(name.encode()))
            out.close()
            return
