"""Salary texts to amounts, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a currency, a period, and the kind of an amount. The first that matches wins.
CURRENCIES = (("EUR", ("€", "eur", "euro")), ("GBP", ("£", "gbp", "quid")), ("USD", ("$", "usd")), ("CHF", ("chf",)))
PERIODS = (
    ("year", ("year", "yr", "annum", "annual", "p.a", "pa ", "/yr", "año", "anual", "jaar", "jahr", "ano")),
    ("month", ("month", "/mo", "p.m", "mensual", "mes", "maand", "monat", "mês", "mensal")),
    ("day", ("day", "daily", "día", "dia", "dag", "tag")),
    ("hour", ("hour", "/hr", "hourly", "hora", "uur", "stunde")),
)
GROSS = ("gross", "bruto", "brutto", "brut")
NET = ("net", "neto", "netto", "líquido", "liquido")
ESTIMATED = ("estimated", "approx", "aprox", "circa", "around", "up to", "hasta")
ANNUAL = (("year", 1), ("month", 12), ("day", 260), ("hour", 2080))


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | text.contains(m)
    return found


def _first(text: Column, choices: tuple) -> Column:
    out = None
    for value, marks in choices:
        out = F.when(_any(text, marks), value) if out is None else out.when(_any(text, marks), value)
    return out


def _amount(token: Column) -> Column:
    """A trimmed token's number."""
    suffix = F.lower(F.right(token, F.lit(1)))
    times = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).otherwise(1.0)
    digits = F.trim(F.regexp_replace(token, "[kKmM]$", ""))
    comma, dot = F.length(digits) - F.instr(F.reverse(digits), ","), F.length(digits) - F.instr(F.reverse(digits), ".")
    has_comma, has_dot = digits.contains(","), digits.contains(".")
    bare = (
        F.when(has_comma & has_dot, F.when(comma > dot, F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(digits, ",", "")))
        .when(has_comma, F.when(digits.rlike(r",\d{3}\b"), F.regexp_replace(digits, ",", "")).otherwise(F.regexp_replace(digits, ",", ".")))
        .when(has_dot & digits.rlike(r"\.\d{3}\b"), F.regexp_replace(digits, r"\.", ""))
        .otherwise(digits)
    )
    return bare.try_cast("double") * times


def parse_salary(c: Column | str) -> Column:
    """struct<min_amount, max_amount, currency, period, is_gross, is_estimated>; null where nothing is usable."""
    raw = F.col(c) if isinstance(c, str) else c
    text = F.lower(raw)
    currency = _first(text, CURRENCIES)
    # Each list is bound by a lambda, so that no use of it computes it anew.
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    amounts = F.transform(F.regexp_extract_all(raw, F.lit(r"(\d[\d.,]*\s*[kKmM]?)"), 1), lambda t: bound(F.trim(t), _amount))
    first_two = lambda numbers: F.slice(F.when(F.exists(numbers, lambda x: x >= 100), F.filter(numbers, lambda x: x >= 100)).otherwise(numbers), 1, 2)
    two_of = lambda found: bound(F.filter(found, lambda x: x.isNotNull()), first_two)
    made = lambda two: F.when((F.size(two) > 0) | currency.isNotNull(), F.struct(
        F.array_min(two).alias("min_amount"), F.array_max(two).alias("max_amount"), currency.alias("currency"), _first(text, PERIODS).alias("period"),
        F.when(_any(text, GROSS), True).when(_any(text, NET), False).alias("is_gross"), F.when(_any(text, ESTIMATED), True).alias("is_estimated"),
    ))
    return F.when(F.trim(raw) != "", bound(bound(amounts, two_of), made))


def annual_eur(salary: Column) -> Column:
    """Euros a year of a parsed salary, rounded half to even; null for other currencies. No period is a year."""
    times = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ANNUAL for x in pair)), F.coalesce(salary["period"], F.lit("year"))), F.lit(1))
    top = F.coalesce(F.nullif(salary["max_amount"], F.lit(0.0)), salary["min_amount"])
    return F.when(salary["currency"] == "EUR", F.bround(top * times))


def range_text(low: Column | str, high: Column | str, currency: Column | str | None = None, whole: bool = False) -> Column:
    """``lo-hi`` or the one that is there (zero counts as missing), after a currency if one is given."""
    shown = lambda c: F.nullif(c if isinstance(c, Column) else F.col(c), F.lit(0.0))
    text = lambda c: F.format_string("%.0f", c.cast("double")) if whole else F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    lo, hi = shown(low), shown(high)
    span = F.when(lo.isNotNull() & hi.isNotNull(), F.concat_ws("-", text(lo), text(hi))).otherwise(text(F.coalesce(lo, hi)))
    return span if currency is None else F.when(span.isNotNull(), F.concat_ws(" ", currency if isinstance(currency, Column) else F.lit(currency), span))
