"""Skill vocabulary, extraction and matching."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms too general to be skills.
GENERIC_TERMS = ("data", "ai", "it", "software", "cloud", "microsoft", "ms office", "office", "tech")


def vocabulary(postings: DataFrame, col: str = "technologies", most: int | None = None) -> DataFrame:
    """(tech, n) from most to least frequent."""
    out = postings.select(F.explode(col).alias("tech")).where("tech IS NOT NULL").groupBy("tech").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tech")
    return out.limit(most) if most else out


def useful(vocab: DataFrame) -> DataFrame:
    return vocab.where(~F.lower("tech").isin(*GENERIC_TERMS))


def mentions(text: Column, term: Column) -> Column:
    """Whether a term stands in a text, not glued to a letter or digit."""
    return F.regexp_instr(F.lower(text), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.lower(term), F.lit(r"\E(?![a-z0-9])"))) > 0


def extract_skills(text: Column, terms: list[str]) -> Column:
    """The terms that a text mentions, in their order."""
    found = [F.when(F.lower(text).rlike(rf"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])"), F.lit(t)) for t in terms]
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def match(postings: DataFrame, skills: list[str], col: str = "technologies") -> DataFrame:
    """Postings with skills, and the share of them that is among ``skills``: match_pct, matched, missing, n_techs. ``ranked`` orders them."""
    mine = F.array(*(F.lit(s.lower()) for s in skills)).cast("array<string>")
    have = F.filter(col, lambda t: F.array_contains(mine, F.lower(t)))
    lack = F.filter(col, lambda t: ~F.array_contains(mine, F.lower(t)))
    return postings.where(F.size(col) > 0).select(
        "*", (F.size(have) / F.size(col)).alias("match_pct"), F.array_sort(have).alias("matched"), F.array_sort(lack).alias("missing"), F.size(col).cast("long").alias("n_techs")
    )


def ranked(matched: DataFrame, newest: str, *tie: str) -> DataFrame:
    """Matches from best to least: by share, then by evidence (more skills), then newest."""
    return matched.orderBy(F.desc("match_pct"), F.desc("n_techs"), F.desc_nulls_last(newest), *tie)
