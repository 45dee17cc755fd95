"""Profile, health, issues, keys and rules on small literal tables."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import health as h
from tidemark.operators import rules
from tidemark.operators.profile import numeric_summary, profile
from tidemark.sources.tables import demo_orders


@pytest.fixture(scope="module")
def sample(spark):
    day = lambda i: dt.datetime(2024, 1, i)
    emails = ["a@x.com", "b@x.com", "c@x.com", "d@x.com", None]
    rows = [(i, emails[i - 1], "NSNSW"[i - 1], [10.5, 20.0, 30.0, 40.0, 50.0][i - 1], day(i)) for i in range(1, 6)]
    return spark.createDataFrame(rows, "customer_id long, email string, region string, amount double, signup_date timestamp")


def by_column(prof):
    return {r["column"]: r for r in prof.collect()}


def test_sample_profile(sample):
    p = by_column(profile(sample))
    assert p["email"]["nulls"] == 1 and p["email"]["null_pct"] == 20.0 and p["email"]["is_pii"]
    assert [p[c]["sql_type"] for c in ("customer_id", "email", "region", "amount", "signup_date")] == ["INT", "NVARCHAR(50)", "NVARCHAR(50)", "DECIMAL(18,2)", "DATETIME2"]
    assert {c for c in p if p[c]["is_pk_candidate"]} == {"customer_id", "amount", "signup_date"}
    assert h.primary_key(profile(sample)).first()["column"] == "customer_id"


def test_sample_report(sample):
    r = h.report(sample)
    row = r.health.first()
    assert (row["completeness_pct"], row["uniqueness_pct"], row["column_quality_pct"], row["privacy_score"], row["score"], row["grade"]) == (96.0, 100.0, 80.0, 75.0, 90, "A")
    found = {i["id"]: i["severity"] for i in r.issues.collect()}
    assert found == {"nulls_email": "High", "pii_email": "High"}
    assert {x["type"] for x in r.rules.collect()} == {"Completeness", "Uniqueness", "Timeliness", "Volume", "Validity"}
    assert [c["status"] for c in r.cards.orderBy("position").collect()] == ["good", "warn", "good", "warn", "warn"]
    assert r.cards.where("position = 1").first()["value"] == "90/100 (A)"
    assert [d["is_key"] for d in r.declarations.orderBy("ordinal").collect()] == [True, False, False, False, False]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "a long, b string")
    assert h.duplicate_rows(df).first()[0] == 1
    assert h.issues(profile(df), h.duplicate_rows(df)).where("id = 'dup_rows'").first()["severity"] == "Medium"
    odd = spark.createDataFrame([(None, float("nan")), (None, None), (None, float("nan"))], "a long, b double")
    assert h.duplicate_rows(odd).first()[0] == 2 and h.duplicate_rows(odd, by_hash=True).first()[0] == 2


def test_values_decide_personal_data_and_dates(spark):
    rows = [(i, f"+34 600 {i:03d} 123", f"0{i % 9 + 1}-02-2010", "12" if i % 5 else "x", "x" * 300) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, contact string, day string, units string, note string")
    for p in (by_column(profile(df)), by_column(profile(df, sample_order="k"))):
        assert [p[c]["is_pii"] for c in ("contact", "day", "units", "note")] == [True, False, False, False]
        assert p["day"]["date_like"] and p["units"]["number_like"] and not p["contact"]["number_like"]
        assert p["note"]["sql_type"] == "NVARCHAR(500)"


def test_odd_columns_and_empty_table(spark):
    df = spark.createDataFrame([({"a": 1}, [1], None, True)], "m map<string,int>, l array<int>, `a.b` string, f boolean")
    p = by_column(profile(df))
    assert p["m"]["n_distinct"] is None and p["l"]["n_distinct"] == 1 and p["a.b"]["nulls"] == 1 and p["f"]["sql_type"] == "BIT"
    assert h.duplicate_rows(df).first()[0] == 0
    none = df.limit(0)
    assert all(r["null_pct"] == 0.0 and not r["is_pk_candidate"] for r in profile(none).collect())
    row = h.health(profile(none), h.duplicate_rows(none)).first()
    assert row["uniqueness_pct"] == 100.0 and row["duplicate_rows"] == 0


def test_rules(spark, sample):
    assert rules.freshness(sample, "signup_date", "2024-01-07 00:00:00").first()["broken"] is False
    assert rules.freshness(sample, "signup_date", "2024-01-07 00:00:01").first()["broken"] is True
    assert rules.freshness(sample.limit(0), "signup_date", "2024-01-07").first()["broken"] is True
    days = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i // 10),) for i in range(80)] + [(dt.datetime(2024, 1, 10),)], "t timestamp")
    got = [(r["n"], r["broken"]) for r in rules.volume_drops(days, "t").orderBy("day").collect()]
    assert got == [(10, False)] * 8 + [(0, True), (1, True)]
    far = spark.createDataFrame([(i, 1.0 + i % 2, None) for i in range(50)] + [(50, 99.0, None)], "id long, v double, w double")
    assert [(r["id"], r["outlier_columns"]) for r in rules.outliers(far, ["v", "w"]).collect()] == [(50, "v")]


def test_create_table(spark, sample):
    text = h.create_table(sample, profile(sample), "my table!")
    assert text.startswith("CREATE TABLE `my_table`") and "`customer_id` BIGINT NOT NULL" in text and "`email` STRING,\n" in text
    assert h.safe_name("!!") == "ingested_data"


def test_summary_of_demo(spark):
    assert numeric_summary(demo_orders(spark)).first()["p50"] == 103.0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.text("ab", max_size=2))), min_size=1, max_size=30))
def test_profile_invariants(spark, rows):
    df = spark.createDataFrame(rows, "a long, b string")
    one = sorted(map(str, profile(df).collect()))
    assert one == sorted(map(str, profile(df.repartition(3)).collect()))
    for r in profile(df).collect():
        assert r["n_distinct"] + r["nulls"] <= r["n_rows"]
    assert h.duplicate_rows(df).first()[0] == len(rows) - len(set(rows))
