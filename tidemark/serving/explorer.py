"""Filters and orders of the serving queries. A query is a DataFrame; the caller collects its page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels

MOST_ROWS = 1000


@dataclass(frozen=True)
class Filters:
    """markets: country codes, None among them for rows without one."""

    markets: tuple[str | None, ...] = ()
    search: str = ""
    technologies: tuple[str, ...] = ()
    enriched_only: bool = False
    recognised_only: bool = False
    sponsor_only: bool = False
    english_only: bool = False

    def predicate(self) -> Column:
        parts: list[Column] = []
        if self.markets:
            named = [m for m in self.markets if m is not None]
            market = [F.col("country_code").isin(*named)] if named else []
            parts.append(reduce(or_, market + ([F.col("country_code").isNull()] if None in self.markets else [])))
        if self.search:
            parts.append(text_search(self.search, "title", "company_name"))
        parts += [F.coalesce(F.array_contains("technologies", t), F.lit(False)) for t in self.technologies]
        parts += [F.coalesce(F.col(c), F.lit(False)) for on, c in ((self.enriched_only, "is_enriched"), (self.recognised_only, "is_recognised_sponsor"), (self.sponsor_only, "is_visa_sponsor"), (self.english_only, "english_sufficient")) if on]
        return reduce(and_, parts, F.lit(True))


def text_search(needle: str, *columns: str) -> Column:
    """Whether any column holds the text, case aside; nothing in it is a wildcard."""
    return reduce(or_, (F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in columns))


def order(name: str = "signal") -> list[Column]:
    newest = F.desc_nulls_last("last_seen_at")
    yes = lambda c: F.desc(F.coalesce(F.col(c), F.lit(False)))
    return {"signal": [F.desc("is_recognised_sponsor"), newest], "newest": [newest], "language": [yes("english_sufficient"), F.desc("is_recognised_sponsor"), newest]}[name]


def explore(fact: DataFrame, filters: Filters, by: str = "signal", most: int = MOST_ROWS, tie: str = "job_posting_key") -> DataFrame:
    return fact.where(filters.predicate()).orderBy(*order(by), tie).limit(most)


def audit(fact: DataFrame, with_recognised: bool = False, search: str = "") -> DataFrame:
    """The home market's postings, recognised sponsors' everywhere if asked for, with their bucket."""
    home = F.col("country_code") == "NL"
    where = home | F.col("is_recognised_sponsor") if with_recognised else home
    rows = fact.where(where & text_search(search, "title", "company_name")) if search else fact.where(where)
    return rows.withColumn("sponsorship", labels.sponsorship_bucket()).orderBy(*order(), "job_posting_key")


def description(staging: DataFrame, content_hash: str) -> DataFrame:
    return staging.where(F.col("content_hash") == content_hash).select("description_raw").orderBy("description_raw").limit(1)


def sponsor_rate(fact: DataFrame) -> DataFrame:
    """Companies, recognised ones and their share, by corpus."""
    n, k = F.count_distinct("company_name"), F.count_distinct(F.when(F.col("is_recognised_sponsor"), F.col("company_name")))
    return fact.where("company_name IS NOT NULL").groupBy(labels.corpus().alias("corpus")).agg(n.alias("companies"), k.alias("sponsors"), F.coalesce(F.try_divide(k, n), F.lit(0.0)).alias("rate"))


def top_sponsors(fact: DataFrame, k: int = 12) -> DataFrame:
    return fact.where("is_recognised_sponsor AND company_name IS NOT NULL").groupBy("company_name").agg(F.count("*").alias("openings")).orderBy(F.desc("openings"), "company_name").limit(k)


def chartable(df: DataFrame, rows: int) -> bool:
    """Two columns of which one is numeric, and one to thirty rows."""
    numeric = [t for _, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    return len(df.columns) == 2 and len(numeric) == 1 and 1 <= rows <= 30


def audit_counts(fact: DataFrame) -> DataFrame:
    """(postings, at_sponsors, sponsors, unclassified): a posting whose classification is unknown counts as unclassified."""
    known = F.coalesce("is_recognised_sponsor", F.lit(False))
    return fact.agg(
        F.count("*").alias("postings"), F.count_if(known).alias("at_sponsors"), F.count_distinct(F.when(known, F.col("company_name"))).alias("sponsors"),
        F.count_if(~F.coalesce("is_enriched", F.lit(False))).alias("unclassified"),
    )


def select(spark: SparkSession, sql: str, *values: object) -> DataFrame:
    """A query with ``?`` for values, which Spark binds as literals: no value is ever read as SQL."""
    return spark.sql(sql, args=list(values))
