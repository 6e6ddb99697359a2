"""Deterministic, stratified samples for labelling, and the order in which to label them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latest import round_robin

DEFAULT_SEED = "golden-v1"
# Cues that a text may speak of the right to work, and terms that order labelling.
CUES = ("visa", "sponsor", "relocation", "relocate", "work permit", "werkvergunning", "kennismigrant", "highly skilled migrant", "right to work", "work authorization", "work authorisation", "eu citizen", "permiso de trabajo", "arbeitserlaubnis")
SIGNAL_TERMS = (
    r"visa", r"visas", r"sponsor\w*", r"work permit", r"working permit", r"residence permit", r"right to work", r"work authoriz\w+", r"work authoris\w+", r"relocat\w+", r"highly skilled migrant",
    r"kennismigrant", r"blue card", r"blaue karte", r"eu citizen", r"eea", r"work eligibility", r"immigration", r"tier 2", r"skilled worker",
)


def has_cue(text: Column, cues: tuple[str, ...] = CUES) -> Column:
    return F.lower(text).rlike("|".join(cues))


def sample_hash(key: Column, seed: str = DEFAULT_SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def signal_hits(text: Column) -> Column:
    """Distinct terms, lower-cased and sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?iU)\b({'|'.join(SIGNAL_TERMS)})\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def descriptions(postings: DataFrame, content_hash: str = "content_hash", text: str = "description_raw", least: int = 200) -> DataFrame:
    """One description longer than ``least`` for each content hash, the least of them."""
    return postings.where(F.length(text) > least).groupBy(content_hash).agg(F.min(text).alias(text))


def cue_weighted(pool: DataFrame, key: str, strata: str | list[str], text: str, size: int, share: float = 0.6, seed: str = DEFAULT_SEED, exclude: DataFrame | None = None, cues: tuple[str, ...] = CUES) -> DataFrame:
    """``size`` rows: up to ``share`` of them with a cue, spread over strata; the rest without, topped up with cued ones. Keys of ``exclude`` are left out.

    One plan without counts on the driver: cued rows are ranked by their spread, plain rows fill what
    the cued ones up to ``share`` leave, and further cued rows what the plain ones leave.
    """
    if exclude is not None:
        pool = pool.join(exclude.select(key).distinct(), key, "left_anti").select(pool.columns)
    hashed = pool.withColumn("_h", sample_hash(F.col(key), seed)).withColumn("_cue", F.coalesce(has_cue(F.col(text), cues), F.lit(False))).drop(text)
    by = [strata] if isinstance(strata, str) else list(strata)
    wanted = round(size * share)
    cued = round_robin(hashed.where("_cue"), by, "_h", wanted).withColumn("_turn", F.lit(0))
    plain = round_robin(hashed.where("NOT _cue"), by, "_h", size).withColumn("_turn", F.lit(1))
    late = round_robin(hashed.where("_cue").join(cued.select(key), key, "left_anti").select(hashed.columns), by, "_h", size).withColumn("_turn", F.lit(2))
    spread = Window.partitionBy("_turn", *by).orderBy("_h")
    ordered = cued.unionByName(plain).unionByName(late).withColumn("_i", F.row_number().over(spread))
    return ordered.orderBy("_turn", "_i", *by, "_h").limit(size).orderBy("_h").drop("_cue", "_h", "_turn", "_i")


def triage(rows: DataFrame, key: str, text: str, label: str | None = None) -> DataFrame:
    """Rows without a label, those with the most distinct terms first."""
    todo = rows.where(F.col(label).isNull()) if label else rows
    return todo.withColumn("n_hits", F.size(signal_hits(F.col(text))).cast("long")).orderBy(F.desc("n_hits"), key)
