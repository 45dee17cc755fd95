"""Roles, KPIs, recipes, insights, chart queries and answers on small literal tables."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.text import kpi_text, number_text
from tidemark.operators import facts
from tidemark.operators.charts import ChartRequest, chart_query, histogram, shares
from tidemark.operators.dashboard import Roles, column_roles, dashboard, dimension_table, roles_of, simple_report, unmatched
from tidemark.operators.profile import profile


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(dt.datetime(2024, 1, i + 1), *r) for i, r in enumerate([("North", "Widget", 12, 240.0), ("South", "Gadget", 7, 175.5), ("East", "Widget", 20, 400.0), ("West", "Gizmo", 5, 149.75)])]
    return spark.createDataFrame(rows, "date timestamp, region string, product string, units long, revenue double")


def test_dashboard(sales):
    d = dashboard(sales, "Sales")
    assert d.roles == Roles("date", ("units", "revenue"), ("region", "product")) and d.roles.main == "revenue"
    assert [(k["label"], k["value"], k["format"]) for k in d.kpis.orderBy("position").collect()] == [("Total records", 4.0, "int"), ("Total units", 44.0, "number"), ("Total revenue", 965.25, "currency")]
    assert [(r.chart_type, r.dimension) for r in d.recipes] == [("line", "date"), ("bar", "region"), ("bar", "product"), ("pie", "region")]
    said = {r["kind"]: r["text"] for r in d.insights.collect()}
    assert said == {
        "total": "Total revenue across all records is 965.25.", "leader": "'East' leads region with 41% of total revenue.",
        "lowest": "'West' is the lowest region by revenue.", "trend": "revenue trended down 38% from first to last period.",
    }


def test_roles_of_odd_tables(spark):
    none = spark.createDataFrame([("N", "a"), ("S", "b"), ("N", "a")], "region string, status string")
    d = dashboard(none)
    assert d.roles.measures == () and [r.agg for r in d.recipes] == ["count"] and d.insights.first()["kind"] == "none"
    stores = spark.range(60).select((F.col("id") % 3 + 1).alias("Store"), (F.lit(100.0) + F.col("id")).alias("Weekly_Sales"), (F.col("id") % 2 == 0).alias("flag"), F.col("id").alias("row_id"))
    r = roles_of(column_roles(profile(stores)))
    assert r == Roles(None, ("Weekly_Sales", "flag"), ("Store",))
    assert roles_of(column_roles(profile(stores), ("sales",))).measures == ("flag",)
    alone = dashboard(spark.createDataFrame([(float(i),) for i in range(40)], "v double"))
    assert [x.chart_type for x in alone.recipes] == ["histogram"]
    empty = dashboard(spark.createDataFrame([(None, 1.5)], "g string, v double"))
    assert {x["kind"] for x in empty.insights.collect()} == {"total"}


def test_time_chart(spark):
    df = spark.range(120).select((F.lit("2010-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("Date"), (F.lit(1000.0) + F.col("id")).alias("Weekly_Sales"))
    months = [r["value"] for r in chart_query(df, ChartRequest("Date", "Weekly_Sales", grain="month")).collect()]
    assert months == [31465.0, 29246.0, 33294.0, 33135.0]
    weeks = chart_query(df, ChartRequest("Date", "Weekly_Sales", grain="week")).collect()
    assert len(weeks) == 18 and str(weeks[0]["x"])[:10] == "2009-12-28" and [w["value"] for w in weeks[:3]] == [3003.0, 7042.0, 7091.0]
    assert facts.answer(df, ChartRequest("Date", "Weekly_Sales")).first()[0] == "Total Weekly_Sales is \\$127,140 between 2010-01-01 and 2010-04-30."


def test_answers(spark):
    df = spark.createDataFrame([(r, 10.0 * i) for i, r in enumerate(["west", "east", "north"] * 3, 1)], "region string, amount double")
    assert facts.answer(df, ChartRequest("region", "amount")).first()[0] == "Total amount is \\$450; region **north** leads with \\$180 (40% of the total)."
    assert facts.answer(df, ChartRequest("region", "amount", "mean")).first()[0] == "Average amount is \\$50 overall; highest for region **north** at \\$60."
    assert facts.answer(df, ChartRequest("region", None, "count")).first()[0] == "9 rows across 3 region values; most common is **east** with 3."
    assert facts.scalar_answer(df, "amount").first()[0] == "Total amount is \\$450 across 9 rows."
    assert facts.answer(df.limit(0), ChartRequest("region", "amount")).first()[0] == "No numeric values found in amount."
    assert facts.answer(df.limit(0), ChartRequest("region", None, "count")).first()[0] == "0 rows."


def test_missing_groups_and_order(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan")), (None, 5.0), ("c", 1.0)], "g string, v double")
    assert [tuple(r) for r in chart_query(df, ChartRequest("g", "v")).collect()] == [("c", 1.0), ("a", 0.0), ("b", 0.0)]
    assert [r["x"] for r in chart_query(df, ChartRequest("g", "v", chart_type="line")).collect()] == ["a", "b", "c"]
    assert chart_query(spark.range(3), ChartRequest("id"), axis_as_text=True).dtypes[0] == ("x", "string")
    assert histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").first()["n"] == 2


def test_dimension_and_report(sales):
    dim = dimension_table(sales, "product")
    assert dim.count() == 3 and unmatched(sales, dim, "product").count() == 0
    row = simple_report(sales, "date").first()
    assert (row["n_rows"], row["n_columns"], row["n_numeric"]) == (4, 5, 2) and row["history"].startswith("2024-01-01=252.00;")
    assert simple_report(None, "x").first()["error"] == "no source"


def test_number_formats(spark):
    show = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert [show(kpi_text(F.lit(v), F.lit(k))) for v, k in ((1234.4, "currency"), (1234, "int"), (1234.5, "number"), (7, "other"))] == ["$1,234", "1,234", "1,234.50", "7"]
    assert [show(number_text(F.lit(v).cast("double"), m)) for v, m in ((1234.0, True), (1234.567, False), (None, False))] == ["\\$1,234", "1,234.57", "n/a"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from("abcd")), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=25))
def test_chart_invariants(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long")
    every = [tuple(r) for r in chart_query(df, ChartRequest("g", "v")).collect()]
    assert [tuple(r) for r in chart_query(df.repartition(3), ChartRequest("g", "v", top_n=2)).collect()] == every[:2]
    assert sum(v for _, v in every) == sum(v or 0 for g, v in rows if g is not None)
    parts = [r["share"] for r in shares(df, ChartRequest("g", None)).collect()]
    assert not parts or abs(sum(parts) - 1) < 1e-9
