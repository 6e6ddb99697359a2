"""Source payloads (one JSON record per row) to postings. Each mapper is a projection over an explicit schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import salary, text

_UNIX = lambda c: F.timestamp_seconds(c.try_cast("long"))
_BLANK = lambda c: F.nullif(c, F.lit(""))

# The fields of each source's records.
REMOTIVE = "id STRING, url STRING, title STRING, company_name STRING, candidate_required_location STRING, job_type STRING, salary STRING, publication_date STRING, description STRING"
ARBEITNOW = "slug STRING, title STRING, company_name STRING, description STRING, remote BOOLEAN, url STRING, location STRING, job_types ARRAY<STRING>, created_at STRING"
REMOTEOK = "id STRING, position STRING, title STRING, company STRING, location STRING, tags ARRAY<STRING>, description STRING, url STRING, date STRING, salary_min DOUBLE, salary_max DOUBLE"
JOBTECH = """id STRING, headline STRING, webpage_url STRING, publication_date STRING, application_deadline STRING, employer STRUCT<name: STRING, url: STRING>, workplace_address STRUCT<municipality: STRING, region: STRING>,
description STRUCT<text: STRING>, application_details STRUCT<url: STRING>, employment_type STRUCT<label: STRING>, salary_description STRING"""
ADZUNA = "id STRING, title STRING, company STRUCT<display_name: STRING>, location STRUCT<display_name: STRING>, description STRING, redirect_url STRING, created STRING, salary_min DOUBLE, salary_max DOUBLE, contract_time STRING"
HONEYPOT = """id STRING, slug STRING, uuid STRING, title STRING, position STRING, role STRING, company STRING, company_name STRING, url STRING, public_url STRING, apply_url STRING, description STRING, body STRING, location STRING,
city STRING, remote BOOLEAN, salary STRING, salary_min DOUBLE, salary_max DOUBLE, salary_currency STRING, employment_type STRING, contract_type STRING, seniority STRING, experience_level STRING"""


def _remotive(r: Column, _: str) -> dict[str, Column]:
    return {
        "source_job_id": r.id, "source_url": r.url, "title": r.title, "company_name": r.company_name, "description_raw": r.description, "location_raw": r.candidate_required_location, "is_remote_raw": F.lit(True),
        "posted_at": text.parse_instant(r.publication_date), "salary_raw": _BLANK(r.salary), "employment_type_raw": r.job_type,
    }


def _arbeitnow(r: Column, _: str) -> dict[str, Column]:
    return {
        "source_job_id": r.slug, "source_url": r.url, "title": r.title, "company_name": r.company_name, "description_raw": r.description, "location_raw": r.location, "is_remote_raw": r.remote,
        "posted_at": _UNIX(r.created_at), "employment_type_raw": _BLANK(F.array_join(r.job_types, ", ")),
    }


def _remoteok(r: Column, _: str) -> dict[str, Column]:
    return {
        "source_job_id": r.id, "source_url": r.url, "title": F.coalesce(_BLANK(r.position), r.title), "company_name": r.company, "description_raw": r.description, "location_raw": _BLANK(r.location),
        "is_remote_raw": F.lit(True), "posted_at": text.parse_instant(r.date), "salary_raw": salary.range_text(r.salary_min, r.salary_max, "USD"), "employment_type_raw": _BLANK(F.array_join(F.slice(r.tags, 1, 3), ", ")),
    }


def _jobtech(r: Column, _: str) -> dict[str, Column]:
    return {
        "source_job_id": r.id, "source_url": r.webpage_url, "apply_url": r.application_details.url, "title": r.headline, "company_name": r.employer["name"], "company_url": r.employer.url, "description_raw": r.description.text,
        "location_raw": _BLANK(F.concat_ws(", ", _BLANK(r.workplace_address.municipality), _BLANK(r.workplace_address.region))), "country_code": F.lit("SE"), "posted_at": text.parse_instant(r.publication_date),
        "valid_through": text.parse_instant(r.application_deadline), "salary_raw": r.salary_description, "employment_type_raw": r.employment_type.label,
    }


def _adzuna(r: Column, country: str) -> dict[str, Column]:
    return {
        "source_job_id": r.id, "source_url": r.redirect_url, "title": r.title, "company_name": r.company.display_name, "description_raw": r.description, "location_raw": r.location.display_name,
        "country_code": F.lit(country.upper()), "posted_at": text.parse_instant(r.created), "salary_raw": salary.range_text(r.salary_min, r.salary_max, whole=True), "employment_type_raw": r.contract_time,
    }


def _honeypot(r: Column, _: str) -> dict[str, Column]:
    any_of = lambda *names: F.coalesce(*(_BLANK(r[n]) for n in names))
    job = F.coalesce(r.id, r.slug, r.uuid)
    company = F.coalesce(F.when(r.company.startswith("{"), F.get_json_object(r.company, "$.name")).otherwise(_BLANK(r.company)), r.company_name)
    return {
        "source_job_id": job, "source_url": F.coalesce(any_of("url", "public_url"), F.concat(F.lit("https://www.honeypot.io/api/v1/jobs/"), job)), "apply_url": r.apply_url, "title": any_of("title", "position", "role"),
        "company_name": company, "description_raw": any_of("description", "body"), "location_raw": any_of("location", "city"), "country_code": F.lit("NL"), "is_remote_raw": r.remote,
        "salary_raw": F.coalesce(_BLANK(r.salary), salary.range_text(r.salary_min, r.salary_max, F.coalesce(_BLANK(r.salary_currency), F.lit("EUR")))),
        "employment_type_raw": any_of("employment_type", "contract_type"), "seniority_raw": any_of("seniority", "experience_level"),
    }


REGISTRY: dict[str, tuple[str, Callable]] = {"remotive": (REMOTIVE, _remotive), "arbeitnow": (ARBEITNOW, _arbeitnow), "remoteok": (REMOTEOK, _remoteok), "jobtech": (JOBTECH, _jobtech), "adzuna": (ADZUNA, _adzuna), "honeypot": (HONEYPOT, _honeypot)}
DEFAULT_SOURCES = ("remotive", "arbeitnow", "remoteok")


def postings(records: DataFrame, source: str, run_id: str | None = None, country: str = "nl", col: str = "record") -> DataFrame:
    """Postings of JSON records of a source (KeyError if unknown): those without id, title or URL go, and repeated ids count once."""
    ddl, mapper = REGISTRY[source]
    fields = mapper(_Fields(F.from_json(F.col(col), ddl)), country)
    kinds = {f.name: f.dataType for f in schemas.POSTINGS}
    made = records.select(F.lit(source).alias("source"), F.col(col).alias("raw_payload"), *(F.trim(v).alias(n) if kinds[n].simpleString() == "string" else v.alias(n) for n, v in fields.items()))
    made = made.where("coalesce(source_job_id, '') <> '' AND coalesce(title, '') <> '' AND coalesce(source_url, '') <> ''").dropDuplicates(["source_job_id"])
    own = {"ingestion_run_id": F.lit(run_id).cast("string"), "scraped_at": F.current_timestamp(), "schema_version": F.lit(schemas.SCHEMA_VERSION), "_loaded_at": F.current_timestamp()}
    rest = {f.name: F.lit(None).cast(f.dataType) for f in schemas.POSTINGS if f.name not in made.columns and f.name not in own and f.name != "content_hash"}
    made = made.withColumns(own | rest).withColumn("detected_language", text.detect_language(text.strip_html("description_raw")))
    hashed = made.withColumn("content_hash", text.content_hash("source", "source_job_id", "title", "company_name", "location_raw", "salary_raw", "description_raw"))
    return hashed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.POSTINGS))


class _Fields:
    """Fields of a struct column as attributes."""

    def __init__(self, column: Column):
        self._column = column

    def __getattr__(self, name: str) -> Column:
        return self._column.getField(name)

    __getitem__ = __getattr__
