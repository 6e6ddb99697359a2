"""From the observation log to the star schema. Pure functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import labels, text
from tidemark.operators.latest import clusters, latest, latest_known


def stg_postings(raw: DataFrame) -> DataFrame:
    kept = [c for c in raw.columns if c not in ("raw_payload", "company_name", "country_code")]
    return raw.select(*kept, F.to_date("scraped_at").alias("scraped_date"), text.blank_to_null("company_name").alias("company_name"), text.code("country_code").alias("country_code"))


def stg_enrichment(raw: DataFrame) -> DataFrame:
    return raw.drop("raw_response").withColumn("is_visa_sponsor", F.col("visa_status").isin("explicit_yes", "likely_yes"))


def stg_register(seed: DataFrame) -> DataFrame:
    """One row per normalised name; name and number are the least of each, on their own."""
    named = seed.where("organisation IS NOT NULL").select("organisation", "kvk_number", text.normalize_company("organisation").alias("company_norm"))
    return named.where("company_norm <> ''").groupBy("company_norm").agg(F.min("organisation").alias("organisation"), F.min("kvk_number").alias("kvk_number"))


def deduplicated(postings: DataFrame) -> DataFrame:
    """The newest observation of each source posting, then one representative per cluster: the earliest posted, then the newest seen."""
    newest = latest(postings, ["source", "source_job_id"], F.desc("scraped_at"), F.asc("content_hash"))
    keyed = newest.withColumn("canonical_job_id", text.canonical_key("company_name", "title", "country_code"))
    return clusters(keyed, "canonical_job_id", F.asc_nulls_last("posted_at"), F.desc("scraped_at"), F.asc("content_hash"), F.asc("source"), F.asc("source_job_id"))


def ft_posting(dedup: DataFrame, enrichment: DataFrame, register: DataFrame) -> DataFrame:
    e = enrichment.select("content_hash", *[F.col(c) for c in enrichment.columns if c not in {*dedup.columns}], F.lit(True).alias("_enriched"))
    r = register.select(F.col("company_norm").alias("_norm"), F.col("kvk_number").alias("sponsor_kvk"), F.lit(True).alias("_known"))
    joined = dedup.withColumn("_norm", text.normalize_company("company_name")).join(e, "content_hash", "left").join(r, "_norm", "left")
    return joined.select(
        F.col("canonical_job_id").alias("job_posting_key"), "content_hash", text.surrogate_key("company_name", "country_code").alias("company_key"), text.surrogate_key("source").alias("source_key"),
        F.to_date("posted_at").alias("posted_date_key"), *[c for c in dedup.columns if c not in ("content_hash", "canonical_job_id", "cluster_size", "scraped_at")], F.col("cluster_size").alias("source_count"),
        F.col("scraped_at").alias("last_seen_at"), *[c for c in e.columns if c not in ("content_hash", "_enriched", "is_visa_sponsor")], F.coalesce("is_visa_sponsor", F.lit(False)).alias("is_visa_sponsor"),
        F.col("_enriched").isNotNull().alias("is_enriched"), F.col("_known").isNotNull().alias("is_recognised_sponsor"), "sponsor_kvk",
    )


def ft_snapshot_daily(postings: DataFrame, attributes: tuple[str, ...] = ("company_name", "title", "country_code", "content_hash")) -> DataFrame:
    """One row per source posting and day seen. Each attribute is the day's newest that isn't null, so that a row may mix observations.

    A window over the days gives a posting's lifespan, with no join back.
    """
    from pyspark.sql import Window

    daily = postings.groupBy("source", "source_job_id", "scraped_date").agg(*(latest_known(c, "scraped_at").alias(c) for c in attributes))
    life = Window.partitionBy("source", "source_job_id")
    first, last = F.min("scraped_date").over(life), F.max("scraped_date").over(life)
    return daily.select(
        text.surrogate_key("source", "source_job_id", "scraped_date").alias("snapshot_key"), F.col("scraped_date").alias("date_key"), text.surrogate_key("source").alias("source_key"), "source", "source_job_id", *attributes,
        first.alias("first_seen_date"), last.alias("last_seen_date"),
    ).select("*", (F.col("date_key") == F.col("first_seen_date")).alias("is_first_seen"), (F.col("date_key") == F.col("last_seen_date")).alias("is_last_seen"), F.datediff("date_key", "first_seen_date").cast("long").alias("days_since_first_seen"))


def dt_company(dedup: DataFrame, register: DataFrame) -> DataFrame:
    r = register.select(F.col("company_norm").alias("_norm"), F.col("kvk_number").alias("sponsor_kvk"), F.lit(True).alias("_known"))
    grouped = dedup.where("company_name IS NOT NULL").groupBy("company_name", "country_code").agg(F.count("*").alias("posting_count"), F.min("posted_at").alias("first_posting_at"), F.max("scraped_at").alias("last_seen_at"))
    joined = grouped.withColumn("_norm", text.normalize_company("company_name")).join(r, "_norm", "left")
    return joined.select(text.surrogate_key("company_name", "country_code").alias("company_key"), *grouped.columns, F.col("_known").isNotNull().alias("is_recognised_sponsor"), "sponsor_kvk")


def dt_source(dedup: DataFrame) -> DataFrame:
    s = F.col("source")
    return dedup.select("source").distinct().select(text.surrogate_key("source").alias("source_key"), "source", labels.primary_country(s).alias("primary_country"), labels.source_type(s).alias("source_type"), s.isin("remotive", "remoteok").alias("is_remote_first"))


def dt_date(spark, start: str, end: str) -> DataFrame:
    """Days from start up to, but without, end."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', date_sub(DATE'{end}', 1), INTERVAL 1 DAY)) AS date_key")
    dow = F.dayofweek("date_key") - 1
    return days.select(
        "date_key", F.year("date_key").cast("long").alias("year"), F.month("date_key").cast("long").alias("month"), F.day("date_key").cast("long").alias("day"), F.date_format("date_key", "yyyy-MM").alias("year_month"),
        dow.cast("long").alias("day_of_week"), dow.isin(0, 6).alias("is_weekend"),
    )
