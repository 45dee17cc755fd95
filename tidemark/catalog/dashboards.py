"""Role, KPI, recipe and insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.inputs import money, table
from tidemark.catalog.profiles import frame, with_profile
from tidemark.functions.text import kpi_text
from tidemark.operators import dashboard as d
from tidemark.operators.charts import charts
from tidemark.operators.profile import profile


def roles_sql(name):
    """`r`: the role of each column that has one."""
    return with_profile(name) + """, r AS (SELECT * FROM (SELECT ordinal, col, n_distinct, CASE
      WHEN kind = 'd' THEN CASE WHEN ordinal = (SELECT min(ordinal) FROM prof WHERE kind = 'd') THEN 'date' END
      WHEN kind IN ('i', 'n', 'b') THEN CASE WHEN kind = 'i' AND n_rows > nulls AND n_distinct > 1 AND (n_distinct <= 2 OR (n_distinct <= 50 AND CAST(n_distinct AS DOUBLE) / (n_rows - nulls) <= 0.2)) THEN 'dimension'
        WHEN NOT (lower(col) = 'id' OR ends_with(lower(col), '_id')) THEN 'measure' END
      WHEN n_distinct <= 30 THEN 'dimension' END AS role FROM prof) WHERE role IS NOT NULL)"""


def roles_of(name):
    return (lambda spark, sf: d.column_roles(profile(frame(spark, sf, name))).select("ordinal", "column", "role")), roles_sql(name) + 'SELECT CAST(ordinal AS INTEGER) AS ordinal, col AS "column", role FROM r'


def exact(spark, sf, name, measure):
    """A table whose measure is a decimal, so that sums are the same in any order, and its roles."""
    df = table(spark, sf, name).withColumn(measure, money(measure))
    return df, d.roles_of(d.column_roles(profile(df)))


def kpis(spark, sf):
    df, roles = exact(spark, sf, "orders", "o_totalprice")
    return d.kpis(df, roles)


def kpi_texts(spark, sf):
    return kpis(spark, sf).select("position", kpi_text(F.col("value"), F.col("format")).alias("shown"))


def measure_totals(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("l_extendedprice", money("l_extendedprice"))
    return d.measure_totals(df, d.Roles(None, ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"), ()))


def drawn(spark, sf):
    """The data of all charts of the orders' dashboard, from one read of the table."""
    df = table(spark, sf, "orders").withColumn("o_totalprice", money("o_totalprice"))
    found = d.column_roles(profile(df, "screened")).cache()
    counts = {r["column"]: r["n_distinct"] for r in found.collect()}
    return charts(df, d.chart_recipes(d.roles_of(found), counts))


_TOTAL = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value"
_BY = "SELECT {i} AS request, CAST(row_number() OVER (ORDER BY value DESC, x) AS INTEGER) AS place, x, value FROM (SELECT {x} AS x, " + _TOTAL + " FROM orders WHERE {x} IS NOT NULL GROUP BY 1)"
DRAWN = f"""SELECT 0 AS request, CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS place, x, value FROM (SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS x, {_TOTAL} FROM orders GROUP BY 1)
    UNION ALL SELECT * FROM ({_BY.format(i=1, x='o_orderstatus')}) WHERE place <= 10 UNION ALL SELECT * FROM ({_BY.format(i=2, x='o_orderpriority')}) WHERE place <= 10 UNION ALL {_BY.format(i=3, x='o_orderstatus')}"""


def recipes(name):
    def run(spark, sf):
        df = table(spark, sf, name)
        found = d.column_roles(profile(df)).cache()
        counts = {r["column"]: r["n_distinct"] for r in found.collect()}
        return d.recipe_rows(df, d.chart_recipes(d.roles_of(found), counts))

    words = " ".join(f"WHEN contains(lower(col), '{w}') THEN {i}" for i, w in enumerate(d.PRIORITY))
    sql = roles_sql(name) + f""", dims AS (SELECT col, n_distinct, row_number() OVER (ORDER BY ordinal) AS k FROM r WHERE role = 'dimension'),
    main AS (SELECT col FROM r WHERE role = 'measure' ORDER BY CASE {words} ELSE 99 END, ordinal LIMIT 1), dt AS (SELECT col FROM r WHERE role = 'date'),
    recs AS (SELECT 1 AS g, 'line' AS type, dt.col AS x, main.col AS y, 'sum' AS agg, CAST(NULL AS INTEGER) AS top_n, main.col || ' over time' AS title FROM dt, main
      UNION ALL SELECT 1 + k, 'bar', dims.col, main.col, 'sum', 10, main.col || ' by ' || dims.col FROM dims, main WHERE k <= 2
      UNION ALL SELECT 9, 'pie', dims.col, main.col, 'sum', NULL, main.col || ' share by ' || dims.col FROM dims, main WHERE k = 1 AND n_distinct <= 8
      UNION ALL SELECT 10, 'histogram', col, NULL, 'none', NULL, 'Distribution of ' || col FROM main WHERE (SELECT count(*) FROM dt) = 0 AND (SELECT count(*) FROM dims) = 0
      UNION ALL SELECT 11, 'bar', col, NULL, 'count', 10, 'Row count by ' || col FROM dims WHERE k = 1 AND (SELECT count(*) FROM main) = 0)
    SELECT CAST(row_number() OVER (ORDER BY g) - 1 AS INTEGER) AS position, type, x, y, agg, top_n, title FROM recs"""
    return run, sql


def leaders(spark, sf):
    df, roles = exact(spark, sf, "orders", "o_totalprice")
    return d.insight_leaders(df, roles).withColumn("share", F.round("share", 9))


def trend(spark, sf):
    df, roles = exact(spark, sf, "orders", "o_totalprice")
    return d.insight_trend(df, roles).withColumn("change_pct", F.round("change_pct", 6))


def sentences(spark, sf):
    df, roles = exact(spark, sf, "orders", "o_totalprice")
    return d.insights(df, roles).where("kind <> 'trend'")


def specification(spark, sf):
    """The whole dashboard of the orders as rows (part, name, value)."""
    df = table(spark, sf, "orders").withColumn("o_totalprice", money("o_totalprice"))
    found = d.dashboard(df)
    rows = lambda frame, part, name, value: frame.select(F.lit(part).alias("part"), name.alias("name"), value.alias("value"))
    out = rows(found.kpis, "kpi", F.col("label"), kpi_text(F.col("value"), F.col("format")))
    out = out.unionByName(rows(d.recipe_rows(df, found.recipes), "chart", F.col("title"), F.col("type")))
    return out.unionByName(rows(found.insights, "insight", F.col("kind"), F.col("text")))


def unmatched(spark, sf):
    """Integrity of a dimension table that lacks one value."""
    df = table(spark, sf, "lineitem")
    return d.unmatched(df, d.dimension_table(df, "l_returnflag").where("l_returnflag <> 'A'"), "l_returnflag").select("l_orderkey", "l_linenumber")


def simple(spark, sf):
    return d.simple_report(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").drop("error")


Q = "CAST(o_totalprice AS DECIMAL(18,2))"
GROUPS = f"g AS (SELECT o_orderstatus AS s, CAST(sum({Q}) AS DOUBLE) AS v FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1), t AS (SELECT CAST(sum({Q}) AS DOUBLE) AS total FROM orders)"
SPECIFICATION = """SELECT 'kpi' AS part, label AS name, shown AS value FROM (SELECT position, label FROM ({kpis})) JOIN ({texts}) USING (position)
    UNION ALL SELECT 'chart', title, type FROM ({charts}) UNION ALL SELECT 'insight', kind, text FROM ({sentences})
    UNION ALL SELECT 'insight', 'trend', 'o_totalprice trended ' || CASE WHEN change_pct >= 0 THEN 'up' ELSE 'down' END || format(' {{:.0f}}%', abs(change_pct)) || ' from first to last period.' FROM ({trend})"""
ENTRIES = {
    "dashboard_charts": (drawn, DRAWN),
    **{f"roles_{n}": roles_of(n) for n in ("lineitem", "orders", "part", "supplier", "labels", "events", "documents")},
    "kpis": (kpis, f"""SELECT 0 AS position, 'Total records' AS label, CAST(count(*) AS DOUBLE) AS value, 'int' AS format FROM orders UNION ALL SELECT 1, 'Total o_orderkey', CAST(sum(o_orderkey) AS DOUBLE), 'number' FROM orders
        UNION ALL SELECT 2, 'Total o_custkey', CAST(sum(o_custkey) AS DOUBLE), 'number' FROM orders UNION ALL SELECT 3, 'Total o_totalprice', CAST(sum({Q}) AS DOUBLE), 'currency' FROM orders"""),
    "kpi_texts": (kpi_texts, f"""SELECT 0 AS position, format('{{:,}}', count(*)) AS shown FROM orders UNION ALL SELECT 1, format('{{:,.2f}}', CAST(sum(o_orderkey) AS DOUBLE)) FROM orders
        UNION ALL SELECT 2, format('{{:,.2f}}', CAST(sum(o_custkey) AS DOUBLE)) FROM orders UNION ALL SELECT 3, '$' || format('{{:,.0f}}', CAST(sum({Q}) AS DOUBLE)) FROM orders"""),
    "measure_totals": (measure_totals, """SELECT 0 AS position, 'Total records' AS label, CAST(count(*) AS DOUBLE) AS value, 'int' AS format FROM lineitem
        UNION ALL SELECT 1, 'Total l_orderkey', CAST(sum(l_orderkey) AS DOUBLE), 'number' FROM lineitem UNION ALL SELECT 2, 'Total l_partkey', CAST(sum(l_partkey) AS DOUBLE), 'number' FROM lineitem
        UNION ALL SELECT 3, 'Total l_suppkey', CAST(sum(l_suppkey) AS DOUBLE), 'number' FROM lineitem UNION ALL SELECT 4, 'Total l_extendedprice', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 'currency' FROM lineitem"""),
    **{f"chart_recipes_{n}": recipes(n) for n in ("lineitem", "labels", "supplier", "part", "events", "pages")},
    "insight_leaders": (leaders, f"""WITH {GROUPS}, o AS (SELECT *, row_number() OVER (ORDER BY v DESC, s) AS a, row_number() OVER (ORDER BY v, s DESC) AS b FROM g)
        SELECT 'total' AS kind, 'o_totalprice' AS subject, total AS value, CAST(NULL AS DOUBLE) AS share FROM t UNION ALL SELECT 'leader', s, v, round(v / total, 9) FROM o, t WHERE a = 1 UNION ALL SELECT 'lowest', s, v, round(v / total, 9) FROM o, t WHERE b = 1"""),
    "insight_trend": (trend, f"""WITH x AS (SELECT o_orderdate AS x, CAST(sum({Q}) AS DOUBLE) AS v FROM orders GROUP BY 1), e AS (SELECT arg_min(v, x) AS first, arg_max(v, x) AS last FROM x)
        SELECT first, last, round((last - first) / first * 100, 6) AS change_pct FROM e"""),
    "insight_sentences": (sentences, f"""WITH {GROUPS}, o AS (SELECT *, row_number() OVER (ORDER BY v DESC, s) AS a, row_number() OVER (ORDER BY v, s DESC) AS b FROM g)
        SELECT 'total' AS kind, 'Total o_totalprice across all records is ' || format('{{:,.2f}}', total) || '.' AS text FROM t
        UNION ALL SELECT 'leader', '''' || s || ''' leads o_orderstatus with ' || format('{{:.0f}}%', v / total * 100) || ' of total o_totalprice.' FROM o, t WHERE a = 1
        UNION ALL SELECT 'lowest', '''' || s || ''' is the lowest o_orderstatus by o_totalprice.' FROM o WHERE b = 1"""),
    "dimension_table": (lambda s, f: d.dimension_table(table(s, f, "customer"), "c_mktsegment"), "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL"),
    "dimension_unmatched": (unmatched, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'"),
    "simple_report": (simple, """WITH h AS (SELECT row_number() OVER (ORDER BY c_custkey) AS k, CAST(c_custkey + c_nationkey AS DECIMAL(38,2)) AS v FROM customer)
        SELECT (SELECT count(*) FROM customer) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(2 AS BIGINT) AS n_numeric, string_agg(CAST(CAST(DATE '2024-01-01' + CAST(k - 1 AS INTEGER) AS DATE) AS VARCHAR) || '=' || CAST(v AS VARCHAR), ';' ORDER BY k) AS history FROM h WHERE k <= 10"""),
}
ENTRIES["dashboard_spec"] = (specification, SPECIFICATION.format(kpis=ENTRIES["kpis"][1], texts=ENTRIES["kpi_texts"][1], charts=recipes("orders")[1], sentences=ENTRIES["insight_sentences"][1], trend=ENTRIES["insight_trend"][1]))
