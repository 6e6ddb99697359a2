import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.evals import metrics, replay
from tidemark.operators import latest as ops
from tidemark.plans import models
from tidemark.quality import checks
from tidemark.serving import enrich, guard
from tidemark.sinks import log
from tidemark.sinks.upsert import VersionedTable
from tidemark.sources import http, jsonld, payloads, register


def test_upsert_is_idempotent(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "k string, at int, v string")
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    t.upsert(rows, ["k"], "at")
    t.upsert(rows, ["k"], "at")
    t.upsert(spark.createDataFrame([("a", 0, "z")], "k string, at int, v string"), ["k"], "at")
    assert sorted(map(tuple, t.read().collect())) == [("a", 0, "z"), ("b", 1, "y")]


def test_two_writers_lose_nothing(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "k string, at int")
    late = VersionedTable(spark, t.root, t.schema)
    stale, calls = late.version, []
    late.version = lambda: stale() if calls else calls.append(1) or 0  # what it saw before the other wrote
    t.upsert(spark.createDataFrame([("a", 1)], t.schema), ["k"], "at")
    late.upsert(spark.createDataFrame([("b", 1)], t.schema), ["k"], "at")
    assert sorted(r.k for r in t.read().collect()) == ["a", "b"] and t.version() == 2


def test_latest_known_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, "NL", "old"), ("a", 2, None, "new")], "source_job_id string, scraped_at int, country_code string, title string")
    r = df.groupBy("source_job_id").agg(ops.latest_known("country_code", "scraped_at").alias("c"), ops.latest_known("title", "scraped_at").alias("t")).first()
    assert (r.c, r.t) == ("NL", "new")


def test_cluster_prefers_dated(spark):
    df = spark.createDataFrame([("k", None, 5), ("k", 3, 1)], "key string, posted int, seen int")
    r = ops.clusters(df, "key", F.asc_nulls_last("posted"), F.desc("seen")).collect()
    assert [(x.posted, x.cluster_size) for x in r] == [(3, 2)]


def test_star_schema_passes_its_suite(spark):
    t = datetime(2024, 1, 1)
    post = [("remotive", str(i), "u", t, f"Role {i % 2}", "Acme B.V." if i else None, "nl ", t, f"h{i}") for i in range(4)]
    raw = spark.createDataFrame(post, "source string, source_job_id string, source_url string, scraped_at timestamp, title string, company_name string, country_code string, posted_at timestamp, content_hash string")
    enr = spark.createDataFrame([("h1", "likely_yes", 0.9)], "content_hash string, visa_status string, visa_confidence double")
    stg, ste, reg = models.stg_postings(raw), models.stg_enrichment(enr), models.stg_register(spark.createDataFrame([("ACME", "012")], schemas.REGISTER))
    dedup = models.deduplicated(stg)
    ft = models.ft_posting(dedup, ste, reg).withColumn("canonical_job_id", F.col("job_posting_key"))
    tables = {
        "raw_job_postings": raw, "raw_job_enrichment": enr, "stg_job_postings": stg, "stg_job_enrichment": ste, "stg_recognised_sponsors": reg, "int_job_postings_deduplicated": dedup, "ft_job_posting": ft,
        "ft_job_snapshot_daily": models.ft_snapshot_daily(stg), "dt_company": models.dt_company(dedup, reg), "dt_source": models.dt_source(dedup), "dt_date": models.dt_date(spark, "2024-01-01", "2024-01-05"),
    }
    assert len(checks.suite()) == 45
    assert [x for x in checks.run(checks.suite(), tables) if x[2]] == []
    assert {r.sponsor_kvk for r in ft.where("is_recognised_sponsor").collect()} == {"012"}
    broken = tables | {"dt_source": tables["dt_source"].unionAll(tables["dt_source"])}
    assert [x[1] for x in checks.run(checks.suite(), broken) if x[2]] == ["unique(source_key)", "unique(source)"]


@pytest.mark.parametrize("sql", ["select 1", "with a as (select 1 x) select x from a", "select replace('a','b','c')", "select 1 limit 10 offset 20", "select 'drop table' as x"])
def test_guard_accepts(spark, sql):
    assert guard.is_safe_select(sql)
    assert guard.ask(spark, sql, set()).count() == 1 or "offset" in sql


@pytest.mark.parametrize("sql", ["drop table x", "delete from x", "select 1; drop table x", "update x set a=1", "attach 'x'", "pragma x", "create or replace table x as select 1", "insert or replace into x values (1)", "with a as (select 1) insert into x select * from a", ""])
def test_guard_rejects(sql):
    assert not guard.is_safe_select(sql)


def test_guard_relations_and_limits(spark):
    spark.range(3).createOrReplaceTempView("mart")
    assert guard.ask(spark, "select * from mart", {"mart"}).count() == 3
    for sql in ("select * from secret", "select * from parquet.`/etc/x`", "select * from mart where id in (select id from secret)"):
        with pytest.raises(ValueError):
            guard.ask(spark, sql, {"mart"})
    assert guard.enforce_limit("select 1").endswith("LIMIT 200")
    assert guard.enforce_limit("select 1 limit 10000") == "select 1 limit 500"
    assert guard.enforce_limit("select 1 limit 50") == "select 1 limit 50"
    assert guard.enforce_limit("select * from (select 1 limit 5) t").endswith("LIMIT 200")
    assert guard.build_sql("q", lambda q: "Here:\n```sql\nselect 1;\n```") == "select 1\nLIMIT 200"
    with pytest.raises(ValueError):
        guard.build_sql("q", lambda q: "drop table x")


def test_metrics(spark):
    pairs = spark.createDataFrame([("explicit_yes", "explicit_yes"), ("explicit_yes", "unclear"), ("unclear", "explicit_yes"), ("unclear", "unclear")], "truth string, pred string")
    by = {r.label: r.asDict() for r in metrics.class_metrics(pairs).collect()}
    assert (by["explicit_yes"]["support"], by["explicit_yes"]["predicted"], by["explicit_yes"]["tp"], by["explicit_yes"]["precision"]) == (2, 2, 1, 0.5)
    assert by["likely_no"]["f1"] == 0.0
    overall = metrics.macro(metrics.class_metrics(pairs)).first().asDict()
    assert overall["accuracy"] == 0.5 and overall["macro_recall"] == 0.5
    assert metrics.thresholds_missed(list(by.values()), overall, {"accuracy": 0.7, "likely_no.recall": 0.5, "_note": 1}) == ["accuracy: 0.5000 < 0.7"]
    a = metrics.agreement(spark.createDataFrame([(False, False)], "a boolean, b boolean")).first()
    assert a.raw_agreement == 1.0 and a.b_given_a is None


def test_breaker_and_replay():
    class Broken:
        model = "m"

        def __init__(self):
            self.calls = 0

        def classify(self, key, prompt):
            self.calls += 1
            if self.calls == 1:
                return "answer"
            raise RuntimeError

    broken = Broken()
    assert list(enrich.classify_many(broken, [(str(i), "p") for i in range(20)])) == [("0", "answer")] and broken.calls == 6
    assert list(enrich.classify_many(enrich.Replay({"a": "x"}), [("a", "p"), ("b", "p")])) == [("a", "x")]
    assert enrich.provider("replay", {"replay": lambda: enrich.Replay({})}).model == "replay"
    with pytest.raises(ValueError):
        enrich.provider("other", {"replay": lambda: enrich.Replay({})})


def test_enrichment_keeps_what_it_has(spark):
    class Fails:
        model = "m"

        def classify(self, key, prompt):
            if int(key) >= 12:
                raise RuntimeError
            return "x"

    rows = spark.createDataFrame([(str(i), "p") for i in range(30)], "k string, p string").coalesce(1)
    kept = []
    assert enrich.enrich_pending(rows, "k", "p", Fails(), kept.extend) == 12 == len(kept)


def test_eval_runner(spark):
    golden = spark.createDataFrame([("a", "explicit_yes", "p", "bad"), ("b", None, "p", "bad")], "content_hash string, visa_status_true string, prompt_input string, text_sha256 string")
    none = spark.createDataFrame([], "content_hash string, response struct<visa: struct<status: string>>")
    assert replay.run(golden, none, {})["outcome"] == "nothing to score"
    one = spark.createDataFrame([("a", (("explicit_yes",),))], none.schema)
    report = replay.run(golden, one, {"accuracy": 0.7})
    assert (report["scored"], report["drifted"], report["missed"], report["outcome"]) == (1, 2, [], "missed")


def test_drift(spark):
    g = spark.createDataFrame([("h", "0" * 64, "text")], "content_hash string, text_sha256 string, prompt_input string")
    assert replay.drifted(g).count() == 1


def test_sources(spark):
    remoteok = [json.dumps({"legal": "x"}), json.dumps({"id": 7, "position": "Dev", "company": "A", "url": "u", "tags": ["a", "b", "c", "d"], "date": "2024-01-02T00:00:00+00:00", "salary_min": 10, "salary_max": 20, "location": ""})]
    rows = payloads.postings(spark.createDataFrame([(r,) for r in remoteok], "record string"), "remoteok").collect()
    assert [(r.source_job_id, r.salary_raw, r.employment_type_raw, r.location_raw) for r in rows] == [("7", "USD 10-20", "a, b, c", None)]
    jobtech = json.dumps({"id": "1", "headline": "T", "webpage_url": "u", "employer": {"name": "E"}, "workplace_address": {"municipality": "Lund", "region": None}, "description": {"text": "d"}})
    r = payloads.postings(spark.createDataFrame([(jobtech,), (jobtech,)], "record string"), "jobtech").collect()
    assert len(r) == 1 and (r[0].country_code, r[0].location_raw) == ("SE", "Lund")
    honeypot = json.dumps({"slug": "s", "role": "R", "company": {"name": "C"}, "salary_min": 5})
    h = payloads.postings(spark.createDataFrame([(honeypot,)], "record string"), "honeypot").first()
    assert (h.company_name, h.salary_raw, h.source_url[-2:]) == ("C", "EUR 5", "/s")
    with pytest.raises(KeyError):
        payloads.postings(spark.createDataFrame([], "record string"), "nowhere")
    pages = ["<table><tbody><tr><th>Organisation</th><td>No</td></tr><tr><th>A<b> &amp;</b> B</th><td>0123</td></tr><tr><th>C</th></tr></tbody></table>", "<tr><th>D</th><td></td></tr>", None]
    found = register.register_rows(spark.createDataFrame([(p,) for p in pages], "html string")).collect()
    assert sorted(map(tuple, found)) == [("A & B", "0123"), ("C", ""), ("D", "")]
    assert jsonld.postings_in(spark.createDataFrame([('<script type="application/ld+json">{bad</script>',), (None,)], "html string")).count() == 0


def test_jsonld_fields(spark):
    node = {"@type": "jobposting", "title": "T", "hiringOrganization": "Acme", "jobLocation": {"address": "Here"}, "baseSalary": {"currency": "EUR", "value": {"value": 5}}, "employmentType": ["FULL", "PART"], "datePosted": "2024-01-02", "identifier": 7}
    page = f'<script type="application/ld+json">{json.dumps([[{"@type": "Thing", "@graph": [node, {"x": 1}]}]])}</script>'
    [r] = jsonld.postings_in(spark.createDataFrame([(page,)], "html string")).collect()
    assert (r.title, r.company_name, r.location_raw, r.country_code, r.salary_raw, r.employment_type_raw, r.source_job_id, str(r.posted_at)) == ("T", "Acme", "Here", None, "EUR 5", "FULL, PART", "7", "2024-01-02 00:00:00")


def test_paging():
    pages = {"u?q=x&page=1&limit=2": {"jobs": [{"i": 1}, {"i": 2}]}, "u?q=x&page=2&limit=2": {"jobs": [{"i": 3}]}}
    assert [r["i"] for r in http.read_query("u", "x", 10, 2, pages.__getitem__)] == [1, 2, 3]
    assert [r["i"] for r in http.read_query("u", "x", 1, 2, pages.__getitem__)] == [1]


def test_paging_counts_complete_records():
    pages = {"u/1?app_id=i&content-type=application%2Fjson&what=x&results_per_page=2": {"results": [{"legal": 1}, {"id": 1, "title": "a", "redirect_url": "r"}]}, "u/2?app_id=i&content-type=application%2Fjson&what=x&results_per_page=2": {"results": [{"id": 1, "title": "a", "redirect_url": "r"}, {"id": 2, "title": "b", "redirect_url": "r"}]}}
    own = {"app_id": "i", "content-type": "application/json"}
    assert [r["id"] for r in http.read_query("u/{page}", "x", 2, 2, pages.__getitem__, http.APIS["adzuna"], own)] == [1, 2]
    with pytest.raises(ValueError):
        http.APIS["adzuna"].parameters({"app_id": "i"})
    assert http.shares(200, 6) == [34, 34, 33, 33, 33, 33] and sum(http.shares(5, 6)) == 5


def test_log_and_status(spark, tmp_path):
    assert log.run_summary([{"unique_id": "test.a", "status": "pass"}, {"unique_id": "model.b", "status": "success"}]) == {"tests_total": 1, "tests_passed": 1, "models_total": 1, "models_passed": 1}
    assert not log.changed({"rows": 1, "generated_at": "a"}, {"rows": 1, "generated_at": "b"})
    df = spark.createDataFrame([("a", datetime(2024, 1, 1))], "source string, scraped_at timestamp")
    path = f"file://{tmp_path}/log"
    assert log.append_postings(df.limit(0), path) == 0
    assert log.append_postings(df, path) == log.append_postings(df, path) == 1
    assert spark.read.parquet(path).count() == 2


def test_stream_matches_batch(spark, tmp_path):
    from tidemark.streaming import snapshot

    ddl = "source string, source_job_id string, scraped_at timestamp, title string"
    rows = [("s", "1", datetime(2024, 1, 1, 1), "a"), ("s", "1", datetime(2024, 1, 1, 2), None), ("s", "2", datetime(2024, 1, 2), "b")]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/in")
    out = []
    q = snapshot.into(snapshot.daily_snapshot(snapshot.observations(spark, f"{tmp_path}/in", ddl), ("title",)), lambda df, i: out.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sorted((r.source_job_id, r.title) for r in out) == [("1", "a"), ("2", "b")]
