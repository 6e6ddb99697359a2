"""A corpus pipeline: quality rules, near-duplicates, repeated spans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
Before a stage the executors give back the heap that the one before has left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, quality, suffix_dedup
from tidemark.llm.common import NULL_ID, Scratch, as_bytes, batches_of, table, trim

#: A decision is not SQL's: the first stage decodes a model that is trained here.
ORACLE_SQL = None
#: Words of a shingle in the near-duplicate stage; op1 alone takes four.
SHINGLE = 5
KEY = "_pipeline_key"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the line field keep. The field learns from labelled documents of the input table.

    Null and empty texts fail the base rule and go; repeated rows and rows without an id are judged
    each by its text. An empty table stays empty.
    """
    trim(spark)
    return quality.keep(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words: the one with the smallest id.

    Texts without words are in no group and stay. Rows without an id are documents of their own,
    behind all others, rows of one id and text are one document, of which one row stays; rows of one
    id with different texts stay or go together. An empty table stays empty.
    """
    trim(spark)
    # Without an id, a digest of the text stands for it; real ids lie below.
    own = F.lit(1 << 61) + F.shiftrightunsigned(F.xxhash64("text"), 3)
    keyed = docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), own))
    judged = Scratch(spark, "pipeline-near").settle(minhash.near_duplicates(keyed.select(KEY, "text"), Scratch(spark, "pipeline-near"), id_col=KEY, k=SHINGLE), "judged")
    kept = keyed.join(judged.where("NOT kept").select(KEY).distinct(), KEY, "left_anti")
    if not judged.groupBy(KEY).count().where("count > 1").isEmpty():
        kept = kept.withColumn(f"{KEY}_sha", F.sha2("text", 256)).dropDuplicates([KEY, f"{KEY}_sha"])
    return kept.select(docs.columns)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that start earlier in a 100-byte string; bytes of a character that was cut go with it, and n_chars counts what remains.

    No row goes: a text that a smaller id has whole becomes empty, a null text stays null. Repeated
    rows are one document and cut alike; an id that is null is the largest. An empty table stays empty.
    """
    trim(spark)
    rows, spans, first = suffix_dedup.plan(docs, Scratch(spark, "pipeline-suffix"))
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    owner = first.select(F.col("sha").alias("_sha"), F.col("k").alias("_rk"), F.col("v").alias("_v"))
    keyed = docs.withColumn("_k", k).withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(owner, "_sha", "left")
    cuts = spans.select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.col("spans").alias("_spans"))
    joined = keyed.join(cuts, ["_k", "_v"], "left").withColumn("_whole", F.col("_k") > F.col("_rk"))
    names, at = docs.columns, {c: i for i, c in enumerate(docs.columns)}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            texts = []
            for raw, text, cut, whole in zip(b.column(at["text"]), as_bytes(b.column(at["text"])), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                if not raw.is_valid:
                    texts.append(None)
                elif whole and len(text) >= suffix_dedup.LENGTH:
                    texts.append("")
                else:
                    texts.append((suffix_dedup.cut(text, cut)[0] if cut else text).decode(errors="ignore"))
            columns = list(b.columns[: len(names)])
            columns[at["text"]] = pa.array(texts, columns[at["text"]].type)
            if "n_chars" in at:
                columns[at["n_chars"]] = pa.array([None if t is None else len(t) for t in texts], columns[at["n_chars"]].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, "_spans", "_whole").mapInArrow(apply, docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of at most 1024 ids. Null texts are an end id alone; repeated rows are documents of their own; an empty table gives no pieces."""
    trim(spark)
    return packing.digests(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
