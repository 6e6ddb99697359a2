"""Data-quality checks: each is compiled to failing rows or, per table, to counts in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas


@dataclass(frozen=True)
class Check:
    """A row check: rows of the table (where ``where`` holds) on which ``bad`` is true fail."""

    name: str
    table: str
    bad: str
    where: str = "true"


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"unique({', '.join(self.columns)})"


@dataclass(frozen=True)
class Relationship:
    table: str
    column: str
    to: str
    to_column: str
    where: str = "true"

    @property
    def name(self) -> str:
        return f"relationship({self.column})"


def not_null(table: str, column: str) -> Check:
    return Check(f"not_null({column})", table, f"`{column}` IS NULL")


def accepted(table: str, column: str, values: Sequence[str], where: str = "true") -> Check:
    listed = ", ".join(f"'{v}'" for v in values)
    return Check(f"accepted({column})", table, f"`{column}` NOT IN ({listed})", where)


def in_range(table: str, column: str, low: float, high: float) -> Check:
    return Check(f"range({column})", table, f"NOT (`{column}` BETWEEN {low} AND {high})", f"`{column}` IS NOT NULL")


def expression(table: str, sql: str) -> Check:
    return Check(f"expression({sql})", table, f"NOT ({sql})")


def failing_rows(check: Check | Unique | Relationship, tables: dict[str, DataFrame]) -> DataFrame:
    df = tables[check.table]
    if isinstance(check, Unique):
        return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in check.columns)).groupBy(*check.columns).agg(F.count("*").alias("n")).where("n > 1")
    if isinstance(check, Relationship):
        child = df.where(check.where).where(F.col(check.column).isNotNull())
        return child.join(tables[check.to].select(F.col(check.to_column).alias(check.column)), check.column, "left_anti")
    return df.where(f"({check.where}) AND coalesce({check.bad}, false)")


def failures(checks: Sequence[Check | Unique | Relationship], tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, chk, failures) of all checks as one plan. The row checks of a table take one pass over it."""
    parts = []
    for name in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == name and isinstance(c, Check)]
        if own:
            counted = tables[name].agg(*(F.expr(f"count_if(({c.where}) AND coalesce({c.bad}, false))").alias(f"c{i}") for i, c in enumerate(own)))
            each = F.array(*(F.struct(F.lit(c.name).alias("chk"), F.col(f"c{i}").alias("failures")) for i, c in enumerate(own)))
            parts.append(counted.select(F.inline(each)).select(F.lit(name).alias("tbl"), "chk", "failures"))
        for c in checks:
            if c.table == name and not isinstance(c, Check):
                parts.append(failing_rows(c, tables).agg(F.count("*").alias("failures")).select(F.lit(name).alias("tbl"), F.lit(c.name).alias("chk"), "failures"))
    return reduce(DataFrame.unionByName, parts)


def run(checks: Sequence[Check | Unique | Relationship], tables: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """(table, check, failures), in one job."""
    return [tuple(r) for r in failures(checks, tables).collect()] if checks else []


def freshness(df: DataFrame, column: str = "_loaded_at", warn_hours: int = 36, error_hours: int = 72, now: Column | None = None) -> DataFrame:
    """(newest, status): pass, warn or error; an empty table is an error."""
    age = (F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp(F.max(column))) / 3600
    return df.agg(F.max(column).alias("newest"), F.when(age.isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass").alias("status"))


def suite() -> list[Check | Unique | Relationship]:
    """The 45 assertions over the log, staging and the star schema."""
    raw, enr, stg, ste, reg, dedup, ft, snap, com, src, day = (
        "raw_job_postings", "raw_job_enrichment", "stg_job_postings", "stg_job_enrichment", "stg_recognised_sponsors", "int_job_postings_deduplicated",
        "ft_job_posting", "ft_job_snapshot_daily", "dt_company", "dt_source", "dt_date",
    )
    key = lambda table, column: [not_null(table, column), Unique(table, (column,))]
    kvk = "is_recognised_sponsor OR sponsor_kvk IS NULL"
    return [
        *(not_null(raw, c) for c in ("content_hash", "source", "source_job_id", "scraped_at")),
        *key(enr, "content_hash"), accepted(enr, "visa_status", schemas.VISA_STATUSES),
        not_null(stg, "content_hash"), not_null(stg, "source"), accepted(stg, "source", schemas.SOURCES), not_null(stg, "scraped_date"),
        *key(ste, "content_hash"), in_range(ste, "visa_confidence", 0, 1),
        *key(reg, "company_norm"), not_null(reg, "organisation"),
        *key(dedup, "canonical_job_id"), not_null(dedup, "content_hash"),
        expression(ft, kvk), *key(ft, "job_posting_key"), *key(ft, "canonical_job_id"), in_range(ft, "visa_confidence", 0, 1),
        Relationship(ft, "company_key", com, "company_key", "company_name IS NOT NULL"), Relationship(ft, "source_key", src, "source_key"), not_null(ft, "is_enriched"), not_null(ft, "is_recognised_sponsor"),
        accepted(ft, "visa_status", schemas.VISA_STATUSES, "visa_status IS NOT NULL"),
        Unique(snap, ("date_key", "source", "source_job_id")), *key(snap, "snapshot_key"), not_null(snap, "date_key"),
        expression(com, kvk), *key(com, "company_key"), not_null(com, "is_recognised_sponsor"),
        *key(src, "source_key"), *key(src, "source"),
        *key(day, "date_key"),
    ]
