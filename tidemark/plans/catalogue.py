"""All queries of the engine by name, with SQL that gives the same rows.

Each applies an operator to a stand-in among the test tables: events are observations of a source
(the type) and a posting (the user), documents are postings, labels are what a classifier said of
them, customers and suppliers are companies and a register.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.evals import metrics, sampling
from tidemark.functions import labels, salary, skills, text
from tidemark.operators import latest as ops
from tidemark.plans import models
from tidemark.quality import checks as dq
from tidemark.sinks.upsert import merged
from tidemark.sources.jsonld import postings_in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_job_id"), F.col("ts").alias("scraped_at"), F.to_date("ts").alias("scraped_date"), F.when(F.col("value") >= 50, F.col("value")).alias("level"), "props", "event_id"
    )


@query("""
WITH e AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) AS d, ts, CASE WHEN value >= 50 THEN value END AS level, props FROM events),
g AS (SELECT source, id, d, arg_max(level, ts) AS level, arg_max(props, ts) AS props FROM e GROUP BY ALL),
l AS (SELECT source, id, min(d) AS f, max(d) AS z FROM e GROUP BY ALL)
SELECT md5(g.source || '-' || g.id || '-' || CAST(d AS VARCHAR)) AS snapshot_key, d AS date_key, md5(g.source) AS source_key, g.source, g.id AS source_job_id, level, props,
       f AS first_seen_date, z AS last_seen_date, d = f AS is_first_seen, d = z AS is_last_seen, date_diff('day', f, d) AS days_since_first_seen
FROM g JOIN l ON g.source = l.source AND g.id = l.id""")
def snapshot_daily(spark, sf_dir):
    return models.ft_snapshot_daily(_observations(spark, sf_dir), ("level", "props"))


@query("""SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, sf_dir):
    return ops.latest(_t(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "ts", "value")


_NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_NORM_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_KEY = f"md5(concat_ws('|', {_NORM.format('source')}, {_NORM_TITLE.format('text')}, lower(coalesce(lang, ''))))"


@query(f"""
WITH k AS (SELECT doc_id, {_KEY} AS canonical_job_id, n_chars FROM documents)
SELECT canonical_job_id, doc_id, count(*) OVER (PARTITION BY canonical_job_id) AS cluster_size FROM k
QUALIFY row_number() OVER (PARTITION BY canonical_job_id ORDER BY CASE WHEN n_chars % 3 = 0 THEN n_chars END ASC NULLS LAST, doc_id DESC) = 1""")
def dedup_clusters(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", text.canonical_key("source", "text", "lang").alias("canonical_job_id"), F.when(F.col("n_chars") % 3 == 0, F.col("n_chars")).alias("posted"))
    return ops.clusters(d, "canonical_job_id", F.asc_nulls_last("posted"), F.desc("doc_id")).select("canonical_job_id", "doc_id", "cluster_size")


@query(r"""SELECT doc_id, sha256(concat_ws(chr(31), coalesce(source, ''), lower(trim(regexp_replace(coalesce(text, ''), '[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), lower(coalesce(lang, '')))) AS content_hash FROM documents""")
def content_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.content_hash("source", "text", "lang").alias("content_hash"))


@query("""SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ' ' || c_name END), '') AS company_name, upper(nullif(trim(CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE lower(left(c_mktsegment, 2)) END), '')) AS country_code FROM customer""")
def blank_to_null_staging(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name"))
    return c.select("c_custkey", text.blank_to_null(name).alias("company_name"), text.code(F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.lower(F.left("c_mktsegment", F.lit(2))))).alias("country_code"))


_REG = "WITH r AS (SELECT DISTINCT regexp_extract(s_name, '[0-9]+') AS norm FROM supplier), c AS (SELECT *, regexp_extract(c_name, '[0-9]+') AS norm FROM customer), j AS (SELECT c.*, r.norm IS NOT NULL AS known FROM c LEFT JOIN r ON c.norm = r.norm)"


def _companies(spark, sf_dir):
    """Customers with a flag for those whose number a supplier has too."""
    r = _t(spark, sf_dir, "supplier").select(F.regexp_extract("s_name", "[0-9]+", 0).alias("norm"), F.lit(True).alias("_k")).distinct()
    return _t(spark, sf_dir, "customer").withColumn("norm", F.regexp_extract("c_name", "[0-9]+", 0)).join(r, "norm", "left").withColumn("known", F.col("_k").isNotNull())


@query(_REG + """ SELECT CASE WHEN c_nationkey = 1 THEN 'NL' ELSE 'Remote' END AS corpus, count(DISTINCT c_name) AS companies, count(DISTINCT c_name) FILTER (WHERE known) AS sponsors,
coalesce(round(count(DISTINCT c_name) FILTER (WHERE known)::DOUBLE / nullif(count(DISTINCT c_name), 0), 6), 0) AS rate FROM j WHERE c_name IS NOT NULL GROUP BY 1""")
def register_join_rates(spark, sf_dir):
    n, k = F.count_distinct("c_name"), F.count_distinct(F.when(F.col("known"), F.col("c_name")))
    corpus = labels.corpus(F.when(F.col("c_nationkey") == 1, "NL").otherwise(F.lit("xx")))
    return _companies(spark, sf_dir).where("c_name IS NOT NULL").groupBy(corpus.alias("corpus")).agg(n.alias("companies"), k.alias("sponsors"), F.coalesce(F.round(F.try_divide(k, n), 6), F.lit(0.0)).alias("rate"))


_NAMES = ["ASML Netherlands B.V.", "Adyen N.V.", "Crédit Agricole S.A.", "Foo V.O.F.", "Global Group BV", "Søren & Co", "Straße GmbH", "B&V Partners", "A_B Holding", "Œuvre SRL", "ИB.V.", "İstanbul BV", "", " the  and "]
_DUCK_EDGE = "\\b"
_DUCK_COMPANY = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '\\b(" + "|".join(text.LEGAL_FORMS) + ")\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\b("
    + "|".join(text.NOISE_WORDS) + ")\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query("SELECT name, " + _DUCK_COMPANY.format(c="name") + " AS norm FROM (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ", (NULL)) t(name)")
def normalize_names(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in [*_NAMES, None]], "name string").select("name", text.normalize_company("name").alias("norm"))


_FACT = """
WITH e AS (SELECT doc_id, quality, toxic FROM labels), r AS (SELECT 'src' || s_suppkey AS source, min(s_name) AS kvk FROM supplier GROUP BY 1),
f AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, CASE WHEN e.doc_id IS NULL THEN NULL WHEN e.quality = 1 AND e.toxic = 0 THEN 'likely_yes' WHEN e.quality = 1 THEN 'unclear' ELSE 'explicit_no' END AS visa_status,
      e.doc_id IS NOT NULL AS is_enriched, r.source IS NOT NULL AS is_recognised_sponsor, r.kvk AS sponsor_kvk
      FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id LEFT JOIN r ON d.source = r.source)
"""
_BUCKET = "CASE WHEN is_recognised_sponsor THEN 'Recognised sponsor (IND)' WHEN visa_status IN ('explicit_yes', 'likely_yes') THEN 'LLM-positive only' WHEN NOT is_enriched THEN 'Not yet classified' ELSE 'No sponsorship evidence' END"


def _fact(spark, sf_dir):
    e = _t(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("_e"))
    r = _t(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("src"), F.col("s_suppkey")).alias("source")).agg(F.min("s_name").alias("sponsor_kvk"))
    status = F.when(F.col("_e").isNull(), None).when((F.col("quality") == 1) & (F.col("toxic") == 0), "likely_yes").when(F.col("quality") == 1, "unclear").otherwise("explicit_no")
    d = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(e, "doc_id", "left").join(r, "source", "left").select(
        "doc_id", "source", "lang", "n_chars", status.alias("visa_status"), F.col("_e").isNotNull().alias("is_enriched"), F.col("sponsor_kvk").isNotNull().alias("is_recognised_sponsor"), "sponsor_kvk"
    )


@query(_FACT + f"SELECT f.*, coalesce(visa_status IN ('explicit_yes', 'likely_yes'), false) AS is_visa_sponsor, {_BUCKET} AS bucket FROM f")
def fact_posting(spark, sf_dir):
    return _fact(spark, sf_dir).select("*", F.coalesce(F.col("visa_status").isin("explicit_yes", "likely_yes"), F.lit(False)).alias("is_visa_sponsor"), labels.sponsorship_bucket().alias("bucket"))


@query("""SELECT md5(c_name || '-' || c_nationkey) AS company_key, c_name AS company_name, c_nationkey AS country, count(*) AS posting_count, min(o_orderdate) AS first_posting_at, max(o_orderdate) AS last_seen_at
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name, c_nationkey""")
def dim_company(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    j = o.join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_name", "c_nationkey").agg(F.sum("n").alias("posting_count"), F.min("a").alias("first_posting_at"), F.max("z").alias("last_seen_at"))
    return j.select(text.surrogate_key("c_name", "c_nationkey").alias("company_key"), F.col("c_name").alias("company_name"), F.col("c_nationkey").alias("country"), "posting_count", "first_posting_at", "last_seen_at")


@query("""WITH s AS (SELECT DISTINCT CASE source WHEN 'src0' THEN 'jobtech' WHEN 'src1' THEN 'remotive' WHEN 'src2' THEN 'linkedin' ELSE source END AS source FROM documents)
SELECT md5(source) AS source_key, source, CASE source WHEN 'jobtech' THEN 'SE' WHEN 'honeypot' THEN 'NL' WHEN 'infojobs' THEN 'ES' WHEN 'stepstone' THEN 'DE' WHEN 'irishjobs' THEN 'IE' WHEN 'itjobs' THEN 'PT' END AS primary_country,
CASE WHEN source IN ('linkedin', 'indeed', 'remotive', 'remoteok', 'adzuna') THEN 'aggregator' ELSE 'job_board' END AS source_type, source IN ('remotive', 'remoteok') AS is_remote_first FROM s""")
def dim_source(spark, sf_dir):
    s = F.col("source")
    return models.dt_source(_t(spark, sf_dir, "documents").select(F.when(s == "src0", "jobtech").when(s == "src1", "remotive").when(s == "src2", "linkedin").otherwise(s).alias("source")))


@query("""SELECT d AS date_key, year(d) AS year, month(d) AS month, day(d) AS day, strftime(d, '%Y-%m') AS year_month, dayofweek(d) AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-03-09', INTERVAL 1 DAY)) AS DATE) AS d)""")
def dim_date(spark, sf_dir):
    return models.dt_date(spark, "2024-01-01", "2024-03-10")


@query("""SELECT d.doc_id, d.lang, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY (lang = 'de') DESC NULLS LAST, n_chars DESC, d.doc_id LIMIT 50""")
def pending_queue(spark, sf_dir):
    return ops.pending(_t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _t(spark, sf_dir, "labels"), "doc_id", "lang", "n_chars", 50, home="de")


@query(_FACT + f"SELECT {_BUCKET} AS bucket, lang, count(*) AS n FROM f GROUP BY 1, 2")
def bucket_rollup(spark, sf_dir):
    return _fact(spark, sf_dir).groupBy(labels.sponsorship_bucket().alias("bucket"), "lang").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 10) SELECT user_id, event_type AS bucket, count(*) AS n FROM events JOIN t USING (user_id) GROUP BY 1, 2""")
def topk_rejoin(spark, sf_dir):
    return ops.top_k_rejoin(_t(spark, sf_dir, "events"), "user_id", F.col("event_type"), 10)


@query("""WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 15) SELECT o_custkey, o_orderstatus AS bucket, count(*) AS n FROM orders JOIN t USING (o_custkey) GROUP BY 1, 2""")
def topk_rejoin_orders(spark, sf_dir):
    return ops.top_k_rejoin(_t(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus"), 15)


@query(_FACT + """SELECT count(*) AS postings, count(DISTINCT source) AS sources, count(DISTINCT lang) AS markets, count(*) FILTER (WHERE is_enriched) AS enriched, count(*) FILTER (WHERE is_recognised_sponsor) AS recognised, max(n_chars) AS newest FROM f""")
def totals_strip(spark, sf_dir):
    return _fact(spark, sf_dir).agg(F.count("*").alias("postings"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("markets"), F.count_if("is_enriched").alias("enriched"), F.count_if("is_recognised_sponsor").alias("recognised"), F.max("n_chars").alias("newest"))


@query(_FACT + """SELECT coalesce(lang, 'Remote / global') AS market, count(*) AS postings, count(*) FILTER (WHERE is_enriched) AS enriched, round(100.0 * count(*) FILTER (WHERE is_enriched) / count(*), 1) AS pct FROM f GROUP BY 1""")
def coverage_pct(spark, sf_dir):
    e = F.count_if("is_enriched")
    return _fact(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("Remote / global")).alias("market")).agg(F.count("*").alias("postings"), e.alias("enriched"), F.round(F.lit(100.0).cast("double") * e / F.count("*"), 1).alias("pct"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def trend_by_day(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2")
def trend_by_day_source(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("source")).agg(F.count("*").alias("n"))


@query("SELECT lang AS market, count(*) AS n FROM documents GROUP BY 1")
def postings_by_market(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.col("lang").alias("market")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def postings_by_source(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT nullif(lang, 'en') AS market FROM documents")
def market_options(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.nullif("lang", F.lit("en")).alias("market")).distinct().orderBy(F.asc_nulls_last("market"))


_DUCK_TECH = "list_distinct(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' '), lambda x: length(x) BETWEEN 2 AND 6))"


def _tech(c):
    words = F.split(F.lower(F.regexp_replace(c, "[^A-Za-z ]", " ")), " ")
    return F.array_distinct(F.filter(words, lambda x: F.length(x).between(2, 6)))


@query(_FACT.rstrip() + f""", x AS (SELECT f.*, {_DUCK_TECH} AS tech, d.text FROM f JOIN documents d ON f.doc_id = d.doc_id)
SELECT doc_id, source, lang, is_recognised_sponsor, n_chars FROM x
WHERE (lang IN ('de', 'fr', 'en')) AND contains(lower(text), 'thion') AND list_contains(tech, 'the') AND is_enriched ORDER BY is_recognised_sponsor DESC, n_chars DESC NULLS LAST, doc_id LIMIT 1000""")
def explorer_filter(spark, sf_dir):
    from tidemark.serving.explorer import Filters, explore

    d = _t(spark, sf_dir, "documents").select("doc_id", _tech("text").alias("technologies"), F.col("text").alias("title"))
    rows = _fact(spark, sf_dir).join(d, "doc_id").withColumns({"country_code": F.col("lang"), "company_name": F.lit(None).cast("string"), "last_seen_at": F.col("n_chars")})
    return explore(rows, Filters(markets=("de", "fr", "en"), search="thion", technologies=("the",), enriched_only=True), tie="doc_id").select("doc_id", "source", "lang", "is_recognised_sponsor", "n_chars")


@query(f"SELECT tech, count(*) AS n FROM (SELECT unnest({_DUCK_TECH}) AS tech FROM documents) GROUP BY 1 ORDER BY n DESC, tech LIMIT 40")
def vocabulary_topn(spark, sf_dir):
    return skills.vocabulary(_t(spark, sf_dir, "documents").select(_tech("text").alias("technologies")), most=40)


_SKILLS = ["the", "and", "of", "un", "den"]


@query(f"""WITH t AS (SELECT doc_id, {_DUCK_TECH} AS tech FROM documents), s AS (SELECT doc_id, tech, list_filter(tech, lambda x: x IN ('the', 'and', 'of', 'un', 'den')) AS m FROM t WHERE len(tech) > 0)
SELECT doc_id, round(len(m)::DOUBLE / len(tech), 6) AS match_pct, array_to_string(list_sort(m), ',') AS matched, len(tech) AS n_techs FROM s""")
def skill_match(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", _tech("text").alias("technologies"))
    return skills.match(d, _SKILLS).select("doc_id", F.round("match_pct", 6).alias("match_pct"), F.array_join("matched", ",").alias("matched"), "n_techs")


_VOCAB = ["python", "dbt", "c++", "java", ".net", "airflow"]
_CVS = ["Python, dbt and C++; JavaScript", "java (.NET) airflowed", "nothing"]


@query("SELECT cv, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(cv), '(^|[^a-z0-9]){t.replace('+', chr(92) + '+').replace('.', chr(92) + '.')}($|[^a-z0-9])') THEN '{t}' END" for t in _VOCAB) + "], lambda x: x IS NOT NULL), ',') AS found FROM (VALUES " + ", ".join(f"('{c}')" for c in _CVS) + ") t(cv)")
def skill_extract(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in _CVS], "cv string").select("cv", F.array_join(skills.extract_skills(F.col("cv"), _VOCAB), ",").alias("found"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '"'), '[\s\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS text_md5 FROM pages""")
def strip_html(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_html("html")).alias("text_md5"))


_HTML = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Engineer", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Utrecht", "addressCountry": "nl"}}, "baseSalary": {"currency": "EUR", "value": {"minValue": 1, "maxValue": 2, "unitText": "MONTH"}}}]}</script>'


@query("SELECT 'Engineer' AS title, 'Acme' AS company_name, 'Utrecht, nl' AS location_raw, 'NL' AS country_code, 'EUR 1-2 month' AS salary_raw")
def jsonld_extract(spark, sf_dir):
    return postings_in(spark.createDataFrame([(_HTML,), ("<p>none</p>",), (None,)], "html string"), "html").select("title", "company_name", "location_raw", "country_code", "salary_raw")


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS min_amount, round(o_totalprice, 2) AS max_amount, 'EUR' AS currency, CASE WHEN o_orderkey % 2 = 0 THEN 'month' END AS period FROM orders""")
def salary_parse(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    raw = F.concat(F.lit("€"), F.format_number("o_totalprice", 2), F.when(F.col("o_orderkey") % 2 == 0, " per maand").otherwise(""))
    return o.select("o_orderkey", salary.parse_salary(raw).alias("s")).select("o_orderkey", F.round("s.min_amount", 2).alias("min_amount"), F.round("s.max_amount", 2).alias("max_amount"), "s.currency", "s.period")


_SALARIES = [
    ("€60.000 - €75.000 per year", 60000.0, 75000.0, "EUR", "year", 75000.0), ("EUR 70000-90000 year", 70000.0, 90000.0, "EUR", "year", 90000.0), ("$120,000/yr", 120000.0, 120000.0, "USD", "year", None),
    ("60k - 75k EUR", 60000.0, 75000.0, "EUR", None, 75000.0), ("£45,000 per annum", 45000.0, 45000.0, "GBP", "year", None), ("45.000€ brutos/año", 45000.0, 45000.0, "EUR", "year", 45000.0),
    ("€5.500 per maand", 5500.0, 5500.0, "EUR", "month", 66000.0), ("1.234,56 EUR", 1234.56, 1234.56, "EUR", None, 1235.0), ("competitive salary", None, None, None, None, None), ("3000 maand", 3e9, 3e9, None, "month", None),
]


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _SALARIES) + ") t(raw, min_amount, max_amount, currency, period, annual_eur)")
def salary_texts(spark, sf_dir):
    s = salary.parse_salary("raw")
    return spark.createDataFrame([(r[0],) for r in _SALARIES], "raw string").select("raw", s.alias("s")).select("raw", "s.min_amount", "s.max_amount", "s.currency", "s.period", salary.annual_eur(F.col("s")).alias("annual_eur"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0""")
def cosine_pairs(spark, sf_dir):
    """The search of the rows whose id 50 divides, against all rows of their label."""
    v = _t(spark, sf_dir, "embeddings")
    a, b = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"))
    return a.join(b, "label").where("a <> b").select("a", "b", F.round(text.cosine("x", "y"), 6).alias("cosine"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT").getField("k").alias("k"))


_PAIRS = "WITH p AS (SELECT CASE l.quality WHEN 1 THEN 'explicit_yes' ELSE 'unclear' END AS truth, CASE WHEN d.n_chars % 5 = 0 THEN 'unclear' WHEN d.n_chars % 7 = 0 THEN 'likely_no' ELSE 'explicit_yes' END AS pred FROM labels l JOIN documents d USING (doc_id))"


def _pairs(spark, sf_dir):
    n = F.col("n_chars")
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.when(F.col("quality") == 1, "explicit_yes").otherwise("unclear").alias("truth"), F.when(n % 5 == 0, "unclear").when(n % 7 == 0, "likely_no").otherwise("explicit_yes").alias("pred"))


_CLASSES = _PAIRS + """, c(label) AS (VALUES ('explicit_yes'), ('likely_yes'), ('unclear'), ('likely_no'), ('explicit_no')),
n AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label) AS support, (SELECT count(*) FROM p WHERE pred = label) AS predicted, (SELECT count(*) FROM p WHERE truth = label AND pred = label) AS tp FROM c),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall FROM n), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""


@query(_CLASSES + " SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def class_metrics(spark, sf_dir):
    m = metrics.class_metrics(_pairs(spark, sf_dir))
    return m.select("label", "support", "predicted", "tp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(_CLASSES + " SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(tp) / sum(support), 6) AS accuracy FROM f WHERE support > 0")
def macro_f1(spark, sf_dir):
    m = metrics.macro(metrics.class_metrics(_pairs(spark, sf_dir)))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(_PAIRS + """, c(truth) AS (VALUES ('explicit_yes'), ('likely_yes'), ('unclear'), ('likely_no'), ('explicit_no')) SELECT c.truth, """ + ", ".join(f"count(*) FILTER (WHERE pred = '{x}') AS {x}" for x in ("explicit_yes", "likely_yes", "unclear", "likely_no", "explicit_no")) + " FROM c LEFT JOIN p ON p.truth = c.truth GROUP BY 1")
def confusion(spark, sf_dir):
    return metrics.confusion(_pairs(spark, sf_dir))


@query("""WITH s AS (SELECT quality = 1 AS a, toxic = 1 AS b FROM labels) SELECT count(*) AS n, count(*) FILTER (WHERE a) AS a_positive, count(*) FILTER (WHERE b) AS b_positive, count(*) FILTER (WHERE a AND b) AS both,
round(count(*) FILTER (WHERE a = b) / count(*), 4) AS raw_agreement, round(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a), 0), 4) AS b_given_a, round(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE b), 0), 4) AS a_given_b FROM s""")
def agreement(spark, sf_dir):
    return metrics.agreement(_t(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")))


@query("""WITH h AS (SELECT doc_id, lang, sha256('golden-v1:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('golden-v1:' || doc_id)) AS i FROM documents) SELECT doc_id, lang FROM h ORDER BY i, lang, h LIMIT 60""")
def stratified_sample(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", sampling.sample_hash(F.col("doc_id").cast("string")).alias("h"))
    return ops.round_robin(d, "lang", "h", 60).select("doc_id", "lang")


_CUES = ("tion and", "visa", "und der")


def _sample_sql(pool: str, strata: str, size: int) -> str:
    """The cue-weighted sample of a pool (key, strata, h, cue): cued rows up to 60 %, plain ones, further cued ones."""
    rank = f"row_number() OVER (PARTITION BY {strata} ORDER BY h) AS i"
    return f"""WITH p AS ({pool}), a AS (SELECT *, {rank} FROM p WHERE cue), cued AS (SELECT * FROM a ORDER BY i, {strata}, h LIMIT {round(size * 0.6)}),
plain AS (SELECT *, {rank} FROM p WHERE NOT cue), late AS (SELECT *, {rank} FROM p WHERE cue AND key NOT IN (SELECT key FROM cued)),
u AS (SELECT *, 0 AS turn FROM cued UNION ALL SELECT *, 1 FROM plain UNION ALL SELECT *, 2 FROM late)
SELECT key, {strata} FROM u ORDER BY turn, i, {strata}, h LIMIT {size}"""


_CUE_SQL = "coalesce(" + " OR ".join(f"contains(lower(text), '{c}')" for c in _CUES) + ", false)"


@query(_sample_sql(f"SELECT CAST(doc_id AS VARCHAR) AS key, lang, sha256('golden-v1:' || doc_id) AS h, {_CUE_SQL} AS cue FROM documents", "lang", 40))
def cue_weighted_sample(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang", "text")
    return sampling.cue_weighted(d, "key", "lang", "text", 40, cues=_CUES).select("key", "lang")


@query(_sample_sql(f"SELECT CAST(doc_id AS VARCHAR) AS key, lang, source < 'src15' AS recognised, sha256('golden-v1:' || doc_id) AS h, {_CUE_SQL} AS cue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "lang, recognised", 50))
def golden_sample(spark, sf_dir):
    """Strata of market and register, without the records that are labelled already."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang", (F.col("source") < "src15").alias("recognised"), "text")
    done = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return sampling.cue_weighted(d, "key", ["lang", "recognised"], "text", 50, cues=_CUES, exclude=done).select("key", "lang", "recognised")


_SIGNAL_TEXT = "regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'x', 'g') || CASE WHEN doc_id % 3 = 0 THEN ' Visa sponsorship, visa; kennismigrant' ELSE '' END"
_SIGNALS = "len(list_distinct(list_transform(regexp_extract_all(" + _SIGNAL_TEXT + r", '(?i)\b(" + "|".join(sampling.SIGNAL_TERMS) + r")\b'), lambda x: lower(x))))"


def _with_signals(spark, sf_dir):
    """Documents; every third speaks of the right to work."""
    return _t(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Visa sponsorship, visa; kennismigrant").otherwise("")))


@query(f"SELECT doc_id, {_SIGNALS} AS n_hits FROM documents")
def term_hits(spark, sf_dir):
    return _with_signals(spark, sf_dir).select("doc_id", F.size(sampling.signal_hits(F.col("text"))).cast("long").alias("n_hits"))


@query(f"""SELECT row_number() OVER (ORDER BY n_hits DESC, doc_id) AS place, doc_id, n_hits FROM (SELECT d.doc_id, {_SIGNALS.replace('doc_id', 'd.doc_id')} AS n_hits FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL) ORDER BY place LIMIT 100""")
def triage_order(spark, sf_dir):
    """The first hundred places of the labelling queue."""
    d = _with_signals(spark, sf_dir).join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    first = sampling.triage(d, "doc_id", "text", "quality").limit(100)
    return first.select(F.row_number().over(Window.orderBy(F.desc("n_hits"), "doc_id")).cast("long").alias("place"), "doc_id", "n_hits")


@query("""SELECT 'lineitem' AS tbl, 'not_null(l_orderkey)' AS chk, count(*) FILTER (WHERE l_orderkey IS NULL) AS failures FROM lineitem
UNION ALL SELECT 'lineitem', 'range(l_discount)', count(*) FILTER (WHERE l_discount IS NOT NULL AND NOT (l_discount BETWEEN 0 AND 0.05)) FROM lineitem
UNION ALL SELECT 'lineitem', 'accepted(l_returnflag)', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'lineitem', 'unique(l_orderkey, l_linenumber)', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'orders', 'relationship(o_custkey)', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))""")
def dq_checks(spark, sf_dir):
    tables = {n: _t(spark, sf_dir, n) for n in ("lineitem", "orders")} | {"customer": _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0")}
    return dq.failures([dq.not_null("lineitem", "l_orderkey"), dq.in_range("lineitem", "l_discount", 0, 0.05), dq.accepted("lineitem", "l_returnflag", ("A", "N")), dq.Unique("lineitem", ("l_orderkey", "l_linenumber")), dq.Relationship("orders", "o_custkey", "customer", "c_custkey")], tables)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique_rows(spark, sf_dir):
    return dq.failing_rows(dq.Unique("lineitem", ("l_orderkey", "l_linenumber")), {"lineitem": _t(spark, sf_dir, "lineitem")})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def dq_relationship_rows(spark, sf_dir):
    tables = {"orders": _t(spark, sf_dir, "orders"), "customer": _t(spark, sf_dir, "customer").where("c_custkey % 3 > 0")}
    return dq.failing_rows(dq.Relationship("orders", "o_custkey", "customer", "c_custkey"), tables).select("o_orderkey", "o_custkey")


@query("""WITH b AS (SELECT user_id, event_type, ts, value, event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS v FROM events)
SELECT user_id, event_id, value FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, ts DESC, event_id DESC) = 1""")
def upsert_latest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return merged(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


@query("""SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND length(text) > 200""")
def hash_lookup(spark, sf_dir):
    wanted = _t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _t(spark, sf_dir, "documents").where(F.length("text") > 200).join(wanted, "doc_id", "left_semi").select("doc_id", "n_chars")


@query("""SELECT doc_id, lang FROM documents WHERE """ + " OR ".join(f"lower(text) LIKE '%{c}%'" for c in ("eu citizen", "visa", "the", "sponsor")))
def cue_filter(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(sampling.has_cue(F.col("text"), ("eu citizen", "visa", "the", "sponsor"))).select("doc_id", "lang")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '🌍 Remote / global' ELSE CASE n_nationkey WHEN 1 THEN '🇳🇱 Netherlands' WHEN 2 THEN '🇸🇪 Sweden' ELSE upper(left(n_name, 2)) END END AS market,
CASE WHEN n_nationkey % 3 = 0 THEN '◻️ Not yet classified' WHEN n_nationkey % 3 = 1 THEN '🟢 Sponsorship likely' ELSE '⚪ No signal in the text' END AS visa FROM nation""")
def market_and_visa_labels(spark, sf_dir):
    k = F.col("n_nationkey")
    country = F.when(k % 4 == 0, None).when(k == 1, "NL").when(k == 2, "SE").otherwise(F.concat(F.upper(F.left("n_name", F.lit(2)))))
    return _t(spark, sf_dir, "nation").select("n_nationkey", labels.market_label(country).alias("market"), labels.visa_label(F.when(k % 3 == 1, "likely_yes").otherwise(F.lit("unclear")), k % 3 != 0).alias("visa"))


@query("""SELECT event_id, CASE WHEN h < 1 THEN 'just now' WHEN h < 36 THEN CAST(floor(h) AS BIGINT) || 'h ago' ELSE CAST(floor(h / 24) AS BIGINT) || 'd ago' END AS age, CASE WHEN h < 36 THEN 'good' WHEN floor(h / 24) <= 3 THEN 'warn' ELSE 'bad' END AS tone
FROM (SELECT event_id, (epoch(TIMESTAMP '2024-01-31 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT) / 3600 AS h FROM events)""")
def age_labels(spark, sf_dir):
    label, tone = text.age_label(F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return _t(spark, sf_dir, "events").select("event_id", label.alias("age"), tone.alias("tone"))


@query("SELECT r_regionkey, sha256(concat_ws(chr(31), lower(r_name), trim(regexp_replace(regexp_replace(regexp_replace(lower(r_name), '\\b(remote|asia)\\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '')) AS key FROM region".replace("(remote|asia)", "(remote|hybrid)"))
def canonical_key_stripped(spark, sf_dir):
    return _t(spark, sf_dir, "region").select("r_regionkey", text.canonical_key_stripped(F.lower("r_name"), "r_name", F.lit(None).cast("string")).alias("key"))


@query("""SELECT h AS hours, newest, CASE WHEN h > 72 THEN 'error' WHEN h > 36 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT max(ts) AS newest FROM events), (VALUES (10), (36), (50), (100)) t(h)""")
def source_freshness(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("_loaded_at", F.col("ts"))
    at = lambda h: dq.freshness(e, now=F.max("ts") + F.make_interval(hours=F.lit(h))).select(F.lit(h).alias("hours"), "newest", "status")
    return at(10).unionByName(at(36)).unionByName(at(50)).unionByName(at(100))


@query("""SELECT o_orderpriority AS stratum, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 12""")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("_r", F.row_number().over(w)).where("_r <= 12").select(F.col("o_orderpriority").alias("stratum"), "o_orderkey")


@query(f"""WITH t AS (SELECT doc_id, n_chars, {_DUCK_TECH} AS tech FROM documents), m AS (SELECT doc_id, n_chars, len(tech) AS n_techs, len(list_filter(tech, lambda x: x IN ('the', 'and', 'of', 'un', 'den'))) / len(tech) AS p FROM t WHERE len(tech) > 0)
SELECT doc_id, round(p, 6) AS match_pct, n_techs FROM m ORDER BY p DESC, n_techs DESC, n_chars DESC NULLS LAST, doc_id LIMIT 25""")
def match_ranking(spark, sf_dir):
    """The best 25 matches."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", _tech("text").alias("technologies"))
    return skills.ranked(skills.match(d, _SKILLS), "n_chars", "doc_id").limit(25).select("doc_id", F.round("match_pct", 6).alias("match_pct"), "n_techs")


@query(_FACT + """SELECT count(*) AS postings, count(*) FILTER (WHERE is_recognised_sponsor) AS at_sponsors, count(DISTINCT source) FILTER (WHERE is_recognised_sponsor) AS sponsors, count(*) FILTER (WHERE NOT is_enriched) AS unclassified FROM f""")
def audit_counts(spark, sf_dir):
    from tidemark.serving import explorer

    fact = _fact(spark, sf_dir).withColumn("is_enriched", F.nullif("is_enriched", F.lit(False)))  # unknown counts as not classified
    return explorer.audit_counts(fact.withColumn("company_name", F.col("source")))


@query(_FACT + """SELECT source AS company_name, count(*) AS openings FROM f WHERE is_recognised_sponsor GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def top_sponsors(spark, sf_dir):
    from tidemark.serving import explorer

    return explorer.top_sponsors(_fact(spark, sf_dir).withColumn("company_name", F.col("source")))


@query("""SELECT c_custkey, s_suppkey IS NOT NULL AS is_recognised_sponsor, CASE WHEN s_suppkey IS NOT NULL THEN CAST(s_suppkey AS VARCHAR) END AS sponsor_kvk FROM customer LEFT JOIN supplier ON CAST(right(c_name, 9) AS BIGINT) = CAST(right(s_name, 9) AS BIGINT) AND c_nationkey >= 0""")
def register_match(spark, sf_dir):
    """Companies and a register that spell a name each in their own way, joined on the normalised name."""
    seed = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("The CUSTOMER "), F.right("s_name", F.lit(9)), F.lit(" B.V.")).alias("organisation"), F.col("s_suppkey").cast("string").alias("kvk_number"))
    register = models.stg_register(seed).select(F.col("company_norm").alias("norm"), F.col("kvk_number").alias("sponsor_kvk"))
    companies = _t(spark, sf_dir, "customer").withColumn("norm", text.normalize_company("c_name"))
    return companies.join(register, "norm", "left").select("c_custkey", F.col("sponsor_kvk").isNotNull().alias("is_recognised_sponsor"), "sponsor_kvk")


@query("""WITH x AS (SELECT source || '/' || lang AS content_hash, min(text) AS t FROM documents WHERE length(text) > 200 GROUP BY 1)
SELECT doc_id, md5(t) AS description_md5 FROM documents d JOIN x ON x.content_hash = d.source || '/' || d.lang""")
def described_postings(spark, sf_dir):
    """Postings with one description for each content hash, so that a hash that was seen often counts once."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("content_hash"), F.col("text").alias("description_raw"))
    one = sampling.descriptions(d).select("content_hash", F.md5("description_raw").alias("description_md5"))
    return d.join(one, "content_hash").select("doc_id", "description_md5")


@query("""SELECT doc_id, sha256('Title: ' || CASE WHEN doc_id % 3 = 0 THEN '(none)' ELSE 'T' || doc_id END || chr(10) || 'Company: ' || coalesce(nullif(source, ''), '(unknown)') || chr(10) || 'Location: (unknown)' || chr(10) || 'Country: ' || coalesce(nullif(lang, 'en'), '(unknown)') || chr(10)
|| 'Detected language: ' || coalesce(nullif(lang, ''), '(unknown)') || chr(10) || 'Salary (raw): ' || CASE WHEN n_chars % 2 = 0 THEN '(none)' ELSE CAST(n_chars AS VARCHAR) END || chr(10) || chr(10) || 'Job description:' || chr(10)
|| CASE WHEN coalesce(text, '') = '' THEN '(no description provided)' WHEN length(text) > 6000 THEN left(text, 6000) || ' …[truncated]' ELSE text END) AS prompt_sha256 FROM documents""")
def prompt_digest(spark, sf_dir):
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("T"), F.col("doc_id")))
    prompt = text.prompt_text(title, "source", F.lit(None), F.nullif("lang", F.lit("en")), "lang", F.when(F.col("n_chars") % 2 == 1, F.col("n_chars").cast("string")), "text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(prompt, 256).alias("prompt_sha256"))


#: Answers to a prompt, and whether they break the contract.
_ANSWERS = [
    ('{"visa": {"status": "unclear", "confidence": 0.5}, "seniority": "senior", "technologies": ["python"]}', False), ('{"visa": {"status": "explicit_yes", "confidence": 1, "evidence": "we sponsor"}, "enrichment_confidence": 0.25}', False),
    ('{"normalized_role": "x"}', True), ('{"visa": {"status": "maybe", "confidence": 0.5}}', True), ('{"visa": {"status": "unclear"}}', True), ('{"visa": {"status": "unclear", "confidence": 1.5}}', True),
    ('{"visa": {"status": "unclear", "confidence": 0.5}, "seniority": "guru"}', True), ('{"visa": {"status": "unclear", "confidence": 0.5}, "surprise": 1}', True), ('{"visa": {"status": "unclear", "confidence": 0.5, "mood": "x"}}', True),
    ('{"visa": {"status": "unclear", "confidence": 0.5}, "enrichment_confidence": -1}', True), ("not json", True), ('{"visa": {"status": "unclear", "confidence": 0.5}, "technologies": "python"}', True),
]


@query("SELECT doc_id, answer, failed, CASE WHEN NOT failed THEN answer[22:28] = 'unclear' END AS unclear FROM labels JOIN (VALUES " + ", ".join(f"({i}, '{a}', {f})" for i, (a, f) in enumerate(_ANSWERS)) + f") t(i, answer, failed) ON doc_id % {len(_ANSWERS)} = i")
def answer_contract(spark, sf_dir):
    from tidemark.serving import enrich

    answers = F.array(*(F.lit(a) for a, _ in _ANSWERS))
    d = _t(spark, sf_dir, "labels").select("doc_id", F.get(answers, (F.col("doc_id") % len(_ANSWERS)).cast("int")).alias("answer"))
    return enrich.parsed(d).select("doc_id", "answer", "failed", (F.col("visa.status") == "unclear").alias("unclear"))


@query("""SELECT s_name || ' & Søn' AS organisation, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) END AS kvk_number FROM supplier""")
def register_scan(spark, sf_dir):
    """A page of the register for each nation: half of them without a body, some rows without a number."""
    from tidemark.sources import register

    number = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("<td class='n'> "), F.col("s_suppkey"), F.lit("</td>")))
    row = F.concat(F.lit("<tr><th scope='row'>"), F.regexp_replace("s_name", "#", "<b>#</b>"), F.lit(" &amp; S&oslash;n</th>"), number, F.lit("</tr>"))
    page = F.concat(F.lit("<tr><th>Organisation</th><td>KvK</td></tr><tr><td>no name</td></tr>"), F.array_join(F.collect_list(row), ""))
    pages = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(page.alias("html"))
    html = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("<table><tbody>"), F.col("html"), F.lit("</tbody></table>"))).otherwise(F.col("html"))
    return register.register_rows(pages.select(html.alias("html")))


@query("WITH w AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\\p{L}]+') AS w FROM documents), n AS (SELECT doc_id, text, "
    + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own)}))) AS {code}" for code, own in sorted(text.FUNCTION_WORDS.items()))
    + " FROM w) SELECT doc_id, CASE WHEN length(trim(text)) < 20 OR greatest(de, en, es, fr, nl) = 0 THEN NULL " + " ".join(f"WHEN {c} = greatest(de, en, es, fr, nl) THEN '{c}'" for c in sorted(text.FUNCTION_WORDS)) + " END AS language FROM n")
def detect_language(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.detect_language("text").alias("language"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000.5 AND o_orderpriority <> chr(39) || ' OR 1=1 --'")
def parameterised_select(spark, sf_dir):
    from tidemark.serving import explorer

    _t(spark, sf_dir, "orders").createOrReplaceTempView("param_orders")
    return explorer.select(spark, "SELECT o_orderkey, o_totalprice FROM param_orders WHERE o_orderstatus = ? AND o_totalprice > ? AND o_orderpriority <> ?", "F", 150000.5, "' OR 1=1 --")


#: Statements over one allowed relation, and whether the guard lets them run.
_STATEMENTS = [
    ("select count(*) from mart", True), ("with a as (select id from mart) select max(id) from a limit 5", True), ("select replace('a', 'b', 'c')", True), ("select upper(cast(id as string)) from mart where id in (select id from mart)", True),
    ("drop table mart", False), ("select 1; select 2", False), ("revoke all on mart", False), ("select * from secret", False), ("select reflect('java.lang.System', 'getProperty', 'user.home')", False),
    ("select java_method('java.lang.System', 'getenv', 'HOME')", False), ("select id from mart where try_reflect('java.lang.Runtime', 'getRuntime') is null", False), ("select * from range(5)", False), ("select input_file_name() from mart", False),
    ("select max(reflect('a', 'b')) over (order by id) from mart", False), ("select (select java_method('a', 'b')) from mart", False),
]


@query("SELECT * FROM (VALUES " + ", ".join("('" + q.replace("'", "''") + f"', {ok})" for q, ok in _STATEMENTS) + ") t(statement, runs)")
def guarded_statements(spark, sf_dir):
    from tidemark.serving import guard

    _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).createOrReplaceTempView("mart")

    def runs(sql: str) -> bool:
        try:
            guard.ask(spark, sql, {"mart"})
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(q, runs(q)) for q, _ in _STATEMENTS], "statement string, runs boolean")


@query(r"""SELECT page_id, 'Role ' || page_id AS title, 'Org ' || page_id % 7 AS company_name, 'Utrecht, NL' AS location_raw, 'NL' AS country_code, 'EUR ' || page_id || '-' || (page_id + 10) || ' year' AS salary_raw FROM pages""")
def jsonld_pages(spark, sf_dir):
    """Pages with a posting each, two lists deep in a graph."""
    org = F.concat(F.lit('"hiringOrganization":{"name":"Org '), F.col("page_id") % 7, F.lit('"}'))
    pay = F.concat(F.lit('"baseSalary":{"currency":"EUR","value":{"unitText":"YEAR","minValue":'), F.col("page_id"), F.lit(',"maxValue":'), F.col("page_id") + 10, F.lit("}}"))
    job = F.concat(F.lit('{"@type":["Thing","JobPosting"],"identifier":{"value":"'), F.col("page_id"), F.lit('"},"title":"Role '), F.col("page_id"), F.lit('","jobLocation":[{"address":{"addressLocality":"Utrecht","addressCountry":"NL"}}],'), org, F.lit(","), pay, F.lit("}"))
    block = F.concat(F.lit("<script type='application/ld+json'>broken</script><script type='application/ld+json'> [[{\"@graph\": ["), job, F.lit("]}]] </script>"))
    pages = _t(spark, sf_dir, "pages").select(F.concat("html", block).alias("html"))
    return postings_in(pages).select(F.col("source_job_id").cast("long").alias("page_id"), "title", "company_name", "location_raw", "country_code", "salary_raw")
