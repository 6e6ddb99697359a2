"""Explicit schemas and controlled vocabularies. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "0.3.0"

# Vocabularies of the data contract.
SOURCES = ("remotive", "arbeitnow", "remoteok", "adzuna", "jobtech", "linkedin", "indeed", "honeypot", "techmeabroad", "infojobs", "stepstone", "irishjobs", "itjobs")
VISA_STATUSES = ("explicit_yes", "likely_yes", "unclear", "likely_no", "explicit_no")
SENIORITIES = ("intern", "junior", "mid", "senior", "lead", "principal", "manager", "unknown")
REMOTE_POLICIES = ("onsite", "hybrid", "remote", "remote_country_restricted", "unknown")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "freelance", "internship", "temporary", "unknown")
SALARY_PERIODS = ("year", "month", "day", "hour")

_KINDS = {
    "STRING": T.StringType(), "TIMESTAMP": T.TimestampType(), "BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _struct(ddl: str) -> T.StructType:
    """Flat columns, ``name TYPE [NOT NULL]``. Unlike Spark's own parser this needs no session."""
    fields = []
    for part in ddl.split(","):
        name, kind, *not_null = part.split()
        fields.append(T.StructField(name, _KINDS[kind], not not_null))
    return T.StructType(fields)


POSTINGS = _struct(
    """source STRING NOT NULL, source_job_id STRING NOT NULL, source_url STRING NOT NULL, apply_url STRING, ingestion_run_id STRING,
    scraped_at TIMESTAMP NOT NULL, title STRING NOT NULL, company_name STRING, company_url STRING, description_raw STRING,
    detected_language STRING, country_code STRING, location_raw STRING, is_remote_raw BOOLEAN, posted_at TIMESTAMP, valid_through TIMESTAMP,
    salary_raw STRING, employment_type_raw STRING, seniority_raw STRING, raw_payload STRING, content_hash STRING NOT NULL,
    schema_version STRING NOT NULL, _loaded_at TIMESTAMP NOT NULL"""
)
ENRICHMENT = _struct(
    """content_hash STRING NOT NULL, source STRING NOT NULL, source_job_id STRING NOT NULL, enriched_at TIMESTAMP NOT NULL, model STRING NOT NULL,
    prompt_version STRING NOT NULL, schema_version STRING NOT NULL, input_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE,
    normalized_role STRING, role_family STRING, seniority STRING, employment_type STRING, remote_policy STRING, technologies ARRAY<STRING>,
    visa_status STRING NOT NULL, visa_confidence DOUBLE NOT NULL, visa_evidence STRING, visa_reasoning STRING, requires_local_language BOOLEAN,
    working_languages ARRAY<STRING>, english_sufficient BOOLEAN, relocation_support BOOLEAN, enrichment_confidence DOUBLE, raw_response STRING,
    _loaded_at TIMESTAMP NOT NULL"""
)
REGISTER = _struct("organisation STRING, kvk_number STRING")
GOLDEN = _struct(
    """content_hash STRING, text_sha256 STRING, title STRING, company_name STRING, country_code STRING, source STRING, source_url STRING,
    is_recognised_sponsor BOOLEAN, llm_status_at_sampling STRING, visa_status_true STRING, notes STRING, prompt_input STRING"""
)
VISA = _struct("status STRING, confidence DOUBLE, evidence STRING, reasoning STRING")
CLASSIFICATION = T.StructType(
    [
        *_struct("normalized_role STRING, role_family STRING, seniority STRING, employment_type STRING, remote_policy STRING, technologies ARRAY<STRING>"),
        T.StructField("visa", VISA),
        *_struct("requires_local_language BOOLEAN, working_languages ARRAY<STRING>, english_sufficient BOOLEAN, relocation_support BOOLEAN, enrichment_confidence DOUBLE"),
    ]
)
RESPONSES = _struct("content_hash STRING, text_sha256 STRING, model STRING, prompt_version STRING").add("response", CLASSIFICATION)
RUN_RESULTS = T.StructType(
    [T.StructField("results", T.ArrayType(_struct("unique_id STRING, status STRING"))), T.StructField("metadata", _struct("generated_at STRING, dbt_version STRING")), T.StructField("elapsed_time", T.DoubleType())]
)
