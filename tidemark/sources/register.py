"""A public register's HTML table to (organisation, kvk_number). Spark scans the table; only entities are resolved in batches of Python."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the name that a heading row holds.
HEADING = "organisation"


@F.pandas_udf(StringType())
def _unescaped(cells: pd.Series) -> pd.Series:
    return cells.map(lambda c: html.unescape(c).strip())


def _cell(row: Column, tag: str) -> Column:
    """The text of a row's first cell of a kind, its tags taken out; empty where there is none."""
    return _unescaped(F.regexp_replace(F.regexp_extract(row, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""))


def register_rows(pages: DataFrame, col: str = "html") -> DataFrame:
    """A row for each table row with a named heading cell, in the first table body, or anywhere in a page without one.

    The number may be empty. Heading rows and rows without a name are left out, null pages have no rows.
    """
    body = F.regexp_extract(col, "(?s)<tbody.*?</tbody>", 0)
    rows = F.regexp_extract_all(F.when(body != "", body).otherwise(F.col(col)), F.lit("(?s)<tr.*?</tr>"), F.lit(0))
    cells = pages.select(F.explode(rows).alias("row")).select(_cell(F.col("row"), "th").alias("organisation"), _cell(F.col("row"), "td").alias("kvk_number"))
    return cells.where((F.col("organisation") != "") & (F.lower("organisation") != HEADING))
