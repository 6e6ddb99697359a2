"""Roll-ups and labels, each one expression that every query shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECOGNISED, TEXT_POSITIVE, UNCLASSIFIED, NO_EVIDENCE = "Recognised sponsor (IND)", "LLM-positive only", "Not yet classified", "No sponsorship evidence"
MARKETS = (("NL", "🇳🇱 Netherlands"), ("SE", "🇸🇪 Sweden"), ("DE", "🇩🇪 Germany"), ("ES", "🇪🇸 Spain"))
VISA_LABELS = (
    ("explicit_yes", "✅ Sponsorship offered (explicit)"),
    ("likely_yes", "🟢 Sponsorship likely"),
    ("unclear", "⚪ No signal in the text"),
    ("likely_no", "🟠 Sponsorship unlikely"),
    ("explicit_no", "🔴 No sponsorship (explicit)"),
)


def sponsorship_bucket(recognised: Column | str = "is_recognised_sponsor", status: Column | str = "visa_status", enriched: Column | str = "is_enriched") -> Column:
    """A register match wins over the text, a positive text over being unclassified."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(recognised), RECOGNISED).when(c(status).isin("explicit_yes", "likely_yes"), TEXT_POSITIVE).when(~c(enriched), UNCLASSIFIED).otherwise(NO_EVIDENCE)


def corpus(country: Column | str = "country_code") -> Column:
    """Everything that isn't from the Netherlands, unknown countries too, is remote."""
    c = F.col(country) if isinstance(country, str) else country
    return F.when(c == "NL", "NL").otherwise("Remote")


def _labelled(c: Column, labels: tuple) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in labels for x in pair)), c), c)


def market_label(country: Column) -> Column:
    return F.when(country.isNull(), "🌍 Remote / global").otherwise(_labelled(country, MARKETS))


def visa_label(status: Column, enriched: Column) -> Column:
    return F.when((enriched == F.lit(False)) | status.isNull(), "◻️ Not yet classified").otherwise(_labelled(status, VISA_LABELS))


def primary_country(source: Column) -> Column:
    # Sources of a single country.
    homes = (("jobtech", "SE"), ("honeypot", "NL"), ("infojobs", "ES"), ("stepstone", "DE"), ("irishjobs", "IE"), ("itjobs", "PT"))
    out = F
    for name, country in homes:
        out = out.when(source == name, country)
    return out.otherwise(None)


def source_type(source: Column) -> Column:
    return F.when(source.isin("linkedin", "indeed", "remotive", "remoteok", "adzuna"), "aggregator").otherwise("job_board")
