import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels, salary, skills, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "low", "high", "currency", "period"),
    [
        ("€60.000 - €75.000 per year", 60000, 75000, "EUR", "year"),
        ("EUR 70000-90000 year", 70000, 90000, "EUR", "year"),
        ("$120,000/yr", 120000, 120000, "USD", "year"),
        ("60k - 75k EUR", 60000, 75000, "EUR", None),
        ("60-75k", 75000, 75000, None, None),
        ("£45,000 per annum", 45000, 45000, "GBP", "year"),
        ("1.234,56 EUR", 1234.56, 1234.56, "EUR", None),
        ("3000 maand", 3e9, 3e9, None, "month"),
    ],
)
def test_salary(spark, raw, low, high, currency, period):
    s = one(spark, salary.parse_salary("raw"), raw=raw)
    assert (s.min_amount, s.max_amount, s.currency, s.period) == (low, high, currency, period)


def test_salary_flags(spark):
    assert one(spark, salary.parse_salary("raw"), raw="45.000€ brutos/año").is_gross is True
    assert one(spark, salary.parse_salary("raw"), raw="3.000€ netto per maand").is_gross is False
    assert one(spark, salary.parse_salary("raw"), raw="up to €90,000").is_estimated is True
    assert one(spark, salary.parse_salary("raw"), raw="competitive salary") is None
    assert one(spark, salary.parse_salary("raw"), raw=" ") is None
    assert one(spark, salary.annual_eur(salary.parse_salary("raw")), raw="€5.500 per maand") == 66000


@pytest.mark.parametrize(
    ("name", "norm"),
    [
        ("ASML Netherlands B.V.", "asml"), ("Adyen N.V.", "adyen"), ("Crédit Agricole S.A.", "credit agricole"), ("Foo V.O.F.", "foo"), ("Global Group BV", ""), ("Søren & Co", "s ren"),
        ("Straße GmbH", "stra e"), ("B&V Partners", "partners"), ("A_B Holding", "a b"), ("Œuvre SRL", "uvre"), ("ИB.V.", ""), ("İstanbul BV", "istanbul"), (" the  and ", ""),
    ],
)
def test_normalize_company(spark, name, norm):
    assert one(spark, text.normalize_company("n"), n=name) == norm


def test_keys_meet(spark):
    key = lambda *v: one(spark, text.canonical_key("a", "b", "c"), a=v[0], b=v[1], c=v[2])
    assert key("Acme B.V.", "Data Engineer (m/f)", "NL") == key("acme b v", "data engineer", "nl")
    assert key("Acme", "Data Engineer", "NL") != key("Other", "Data Engineer", "NL")
    assert one(spark, text.canonical_key(F.lit(None), F.lit("x"), F.lit(None))) == one(spark, text.canonical_key(F.lit(""), F.lit("X"), F.lit("")))
    bare = lambda t: one(spark, text.canonical_key_stripped(F.lit("a"), F.lit(t), F.lit("nl")))
    assert bare("Senior Data Engineer (m/w/d) - Remote") == bare("senior data engineer")


def test_text_recipes(spark):
    assert one(spark, text.strip_html("h"), h="<p>a&nbsp;&lt;b</p> c") == "a <b c"
    assert one(spark, text.extract_json("h"), h='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, text.redact("h"), h="https://x/y?key=abc&z=1") == "https://x/y?key=***&z=1"
    assert one(spark, text.truncate("h", 3), h="abcdef") == "abc …[truncated]"
    assert one(spark, text.parse_instant("h").cast("string"), h="2024-05-01T10:00:00Z") == "2024-05-01 10:00:00"
    assert one(spark, text.parse_instant("h"), h="soon") is None
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1.0
    assert one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == 0.0
    assert one(spark, text.cosine(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0.0


def test_labels(spark):
    bucket = lambda r, s, e: one(spark, labels.sponsorship_bucket(F.lit(r), F.lit(s).cast("string"), F.lit(e)))
    assert bucket(True, "explicit_no", True) == labels.RECOGNISED
    assert bucket(False, "likely_yes", True) == labels.TEXT_POSITIVE
    assert bucket(False, None, False) == labels.UNCLASSIFIED
    assert bucket(False, "explicit_no", True) == labels.NO_EVIDENCE


def test_skills(spark):
    terms = ["python", "dbt", "snowflake", "c++", "java", "airflow", ".net"]
    assert one(spark, skills.extract_skills(F.col("t"), terms), t="Python, dbt, Snowflake, C++ and JavaScript") == ["python", "dbt", "snowflake", "c++"]
    assert one(spark, skills.extract_skills(F.col("t"), terms), t="dotnet") == []
    df = spark.createDataFrame([(1, ["python", "dbt"]), (2, ["python", "Kafka"]), (3, ["kafka"]), (4, None), (5, [])], "id int, technologies array<string>")
    got = {r.id: (r.match_pct, r.missing) for r in skills.match(df, ["python", "dbt"]).collect()}
    assert got == {1: (1.0, []), 2: (0.5, ["Kafka"]), 3: (0.0, ["kafka"])}
