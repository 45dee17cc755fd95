"""Chart queries: grouped aggregates, buckets, shares, histogram, and headline figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.inputs import DIRTY, dirty_orders, money, sql_number, table
from tidemark.operators import facts
from tidemark.operators.charts import ChartRequest, chart_query, histogram, shares


def doubled(df):
    return df.withColumn("value", F.col("value").cast("double"))


def top_sum(name, dimension, measure, n):
    def run(spark, sf):
        df = table(spark, sf, name).withColumn(measure, money(measure))
        return doubled(chart_query(df, ChartRequest(dimension, measure, "sum", "bar", n)))

    sql = f"""SELECT {dimension} AS x, CAST(coalesce(sum(CAST({measure} AS DECIMAL(18,2))), 0) AS DOUBLE) AS value
    FROM {name} WHERE {dimension} IS NOT NULL GROUP BY 1 ORDER BY sum(CAST({measure} AS DECIMAL(18,2))) DESC, 1 LIMIT {n}"""
    return run, sql


def by_time(grain):
    def run(spark, sf):
        df = table(spark, sf, "orders").withColumn("o_totalprice", money("o_totalprice"))
        return doubled(chart_query(df, ChartRequest("o_orderdate", "o_totalprice", "sum", "line", grain=grain)))

    sql = f"""SELECT CAST(date_trunc('{grain}', o_orderdate) AS TIMESTAMP) AS x, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"""
    return run, sql


def mean_by(spark, sf):
    df = table(spark, sf, "events").withColumn("value", money("value"))
    return chart_query(df, ChartRequest("event_type", "value", "mean", "bar")).withColumn("value", F.round("value", 6))


def count_top(spark, sf):
    return chart_query(dirty_orders(spark, sf), ChartRequest("status", None, "count", "bar", 2))


def share(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_acctbal", money("c_acctbal"))
    return doubled(shares(df, ChartRequest("c_mktsegment", "c_acctbal", "sum", "pie"))).withColumn("share", F.round("share", 9))


def hist(spark, sf):
    return histogram(table(spark, sf, "part"), "p_retailprice", 20).select("bin", "n")


def as_text(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_extendedprice", money("l_extendedprice"))
    return doubled(chart_query(df, ChartRequest("l_linenumber", "l_extendedprice", "sum", "bar", 10), axis_as_text=True))


def scalar(spark, sf):
    f = facts.scalar_facts(table(spark, sf, "orders").withColumn("o_totalprice", money("o_totalprice")), "o_totalprice")
    return f.select(F.col("total").cast("double").alias("total"), F.round("mean", 6).alias("mean"), "n_values", "n_rows")


def scalar_text(spark, sf):
    return facts.scalar_answer(table(spark, sf, "orders").withColumn("o_totalprice", money("o_totalprice")), "o_totalprice")


def coerced(spark, sf):
    f = facts.scalar_facts(dirty_orders(spark, sf).withColumn("amount", F.regexp_replace("amount", r"\$", "")), "amount")
    return f.select("n_values", "n_rows", F.round("total", 0).alias("total"))


def count_fact(spark, sf):
    return facts.count_facts(dirty_orders(spark, sf), "status")


def time_fact(spark, sf):
    f = facts.time_facts(table(spark, sf, "orders").withColumn("o_totalprice", money("o_totalprice")), "o_orderdate", "o_totalprice")
    return f.select(F.col("total").cast("double").alias("total"), F.round("mean", 6).alias("mean"), "n_values", "first_date", "last_date")


def group_fact(spark, sf):
    f = facts.group_facts(table(spark, sf, "lineitem").withColumn("l_extendedprice", money("l_extendedprice")), "l_returnflag", "l_extendedprice")
    return f.select(F.col("total").cast("double").alias("total"), "leader", F.col("leader_value").cast("double").alias("leader_value"), F.round("leader_share", 9).alias("leader_share"))


def group_text(spark, sf):
    return facts.answer(table(spark, sf, "lineitem").withColumn("l_extendedprice", money("l_extendedprice")), ChartRequest("l_returnflag", "l_extendedprice"))


PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
ENTRIES = {
    "chart_sum_top": top_sum("lineitem", "l_returnflag", "l_extendedprice", 10),
    "chart_sum_top_brands": top_sum("part", "p_brand", "p_retailprice", 10),
    "chart_mean": (mean_by, "SELECT event_type AS x, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 6) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1"),
    "chart_count_top": (count_top, f"WITH {DIRTY} SELECT status AS x, count(*) AS value FROM dirty WHERE status IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2"),
    **{f"chart_time_{g}": by_time(g) for g in ("day", "week", "month", "quarter", "year")},
    "chart_share": (share, """WITH g AS (SELECT c_mktsegment AS x, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value FROM customer GROUP BY 1)
        SELECT x, value, round(value / (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer), 9) AS share FROM g"""),
    "chart_histogram": (hist, """WITH l AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
        SELECT CAST(least(floor((p_retailprice - lo) / (hi - lo) * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM part, l GROUP BY 1"""),
    "category_as_text": (as_text, """SELECT CAST(l_linenumber AS VARCHAR) AS x, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "scalar_answer": (scalar, f"SELECT CAST(sum({PRICE}) AS DOUBLE) AS total, round(CAST(sum({PRICE}) AS DOUBLE) / count(o_totalprice), 6) AS mean, count(o_totalprice) AS n_values, count(*) AS n_rows FROM orders"),
    "scalar_answer_text": (scalar_text, f"SELECT 'Total o_totalprice is \\$' || format('{{:,.2f}}', CAST(sum({PRICE}) AS DOUBLE)) || ' across ' || format('{{:,}}', count(*)) || ' rows.' AS answer FROM orders"),
    "scalar_coerced": (coerced, f"WITH {DIRTY}, n AS (SELECT {sql_number("replace(amount, '$', '')")} AS y FROM dirty) SELECT count(y) AS n_values, count(*) AS n_rows, round(sum(y), 0) AS total FROM n"),
    "count_facts": (count_fact, f"""WITH {DIRTY}, g AS (SELECT status, count(*) AS n FROM dirty WHERE status IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)
        SELECT (SELECT count(*) FROM dirty) AS n_rows, (SELECT count(DISTINCT status) FROM dirty) AS n_groups, status AS leader, n AS leader_value FROM g"""),
    "time_facts": (time_fact, f"SELECT CAST(sum({PRICE}) AS DOUBLE) AS total, round(CAST(sum({PRICE}) AS DOUBLE) / count(o_totalprice), 6) AS mean, count(o_totalprice) AS n_values, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders"),
    "group_facts": (group_fact, """WITH g AS (SELECT l_returnflag AS x, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1),
        t AS (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem)
        SELECT total, x AS leader, v AS leader_value, round(v / total, 9) AS leader_share FROM g, t ORDER BY v DESC, x LIMIT 1"""),
    "group_facts_text": (group_text, """WITH g AS (SELECT l_returnflag AS x, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1),
        t AS (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem)
        SELECT 'Total l_extendedprice is \\$' || format('{:,.2f}', total) || '; l_returnflag **' || x || '** leads with \\$' || format('{:,.2f}', v) || format(' ({:.0f}% of the total).', v / total * 100) AS answer
        FROM g, t ORDER BY v DESC, x LIMIT 1"""),
}
