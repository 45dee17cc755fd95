"""Profile, health and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.inputs import DIRTY, dirty_orders, sql_moment, table
from tidemark.operators import health as h
from tidemark.operators import profile as p
from tidemark.operators import rules, state
from tidemark.scratch import scratch

#: Columns of the given tables and their kinds (i integer, n other number, d date, t text, b boolean).
TABLES = {
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:t l_linestatus:t l_shipdate:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:n o_orderdate:d o_orderpriority:t",
    "customer": "c_custkey:i c_name:t c_nationkey:i c_acctbal:n c_mktsegment:t",
    "supplier": "s_suppkey:i s_name:t s_nationkey:i s_acctbal:n",
    "part": "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:n",
    "events": "event_id:i ts:d user_id:i event_type:t value:n props:t",
    "documents": "doc_id:i text:t lang:t source:t n_chars:i",
    "labels": "doc_id:i quality:i toxic:i",
    "pages": "page_id:i url:t html:t",
    "dirty": "order_id:i status:t amount:t order_date:t total:n flag:b",
}
COLUMNS = {name: [tuple(c.split(":")) for c in spec.split()] for name, spec in TABLES.items()}
EMAIL, PHONE = r"[^@\s]+@[^@\s]+\.[^@\s]+", r"\+?\d[\d\s\-()]{7,}\d"


def frame(spark, sf, name):
    return dirty_orders(spark, sf) if name == "dirty" else table(spark, sf, name)


def profile_sql(name: str) -> str:
    """`prof`: the profile of a table, one SELECT a column."""
    def one(i, c, kind):
        text = kind == "t"
        hits = {"pii": f"regexp_matches({c}, '{EMAIL}') OR regexp_matches({c}, '{PHONE}')", "dat": f"{sql_moment(c)} IS NOT NULL", "num": rf"regexp_full_match(trim({c}), '-?[0-9]+([.][0-9]+)?')"}
        counts = ", ".join(f"count(*) FILTER ({x}) AS {k}" if text else f"0 AS {k}" for k, x in hits.items())
        size = f"coalesce(max(length({c})), 0)" if text else f"coalesce(max(abs(CAST({c} AS HUGEINT))), 0)" if kind == "i" else "0"
        return f"SELECT {i} AS ordinal, '{c}' AS col, '{kind}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, {size} AS size, {counts} FROM {name}"

    rows = " UNION ALL ".join(one(i, c, kind) for i, (c, kind) in enumerate(COLUMNS[name]))
    words = "|".join(p.PII_WORDS)
    types = "CASE kind WHEN 'b' THEN 'BIT' WHEN 'd' THEN 'DATETIME2' WHEN 'n' THEN 'DECIMAL(18,2)' WHEN 'i' THEN CASE WHEN size < 2147483647 THEN 'INT' ELSE 'BIGINT' END ELSE CASE " + " ".join(f"WHEN size <= {n} THEN 'NVARCHAR({n})'" for n in p.TEXT_BUCKETS) + " ELSE 'NVARCHAR(MAX)' END END"
    return f"""raw AS ({rows}),
    seen AS (SELECT *, n_rows - nulls AS n, kind = 't' AND n_rows > nulls AND dat >= 0.8 * (n_rows - nulls) AS date_like FROM raw),
    prof AS (SELECT ordinal, col, kind, n_rows, nulls, coalesce(round_even(CAST(100.0 * nulls / nullif(n_rows, 0) AS DOUBLE), 1), 0) AS null_pct, n_distinct,
      nulls = 0 AND n_distinct = n_rows AND n_rows > 0 AS is_pk_candidate, {types} AS sql_type,
      regexp_matches(lower(col), '{words}') OR (kind = 't' AND NOT date_like AND n > 0 AND pii >= greatest(3, n // 2)) AS is_pii, date_like,
      kind = 't' AND n > 0 AND num >= 0.8 * n AS number_like, num FROM seen)"""


def with_profile(name: str) -> str:
    return "WITH " + (DIRTY + ", " if name == "dirty" else "") + profile_sql(name)


def profile_of(name):
    def run(spark, sf):
        return p.profile(frame(spark, sf, name)).select("ordinal", "column", "nulls", "null_pct", "n_distinct", "is_pk_candidate", "sql_type", "is_pii", "date_like", "number_like")

    return run, with_profile(name) + 'SELECT CAST(ordinal AS INTEGER) AS ordinal, col AS "column", nulls, CAST(null_pct AS DOUBLE) AS null_pct, n_distinct, is_pk_candidate, sql_type, is_pii, date_like, number_like FROM prof'


def screened(name):
    """The keys and roles' counts by a profile that counts exactly only near the thresholds; columns far from all of them have estimates."""
    def run(spark, sf):
        prof = p.profile(frame(spark, sf, name), "screened")
        return prof.select("column", "null_pct", "is_pk_candidate", "sql_type", F.when(F.col("n_distinct") <= 50, F.col("n_distinct")).alias("few_distinct"))

    return run, with_profile(name) + 'SELECT col AS "column", CAST(null_pct AS DOUBLE) AS null_pct, is_pk_candidate, sql_type, CASE WHEN n_distinct <= 50 THEN n_distinct END AS few_distinct FROM prof'


DUPLICATES = "dups AS (SELECT (SELECT count(*) FROM {0}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {0})) AS d)"
HEALTH = DUPLICATES.format("dirty") + """,
sums AS (SELECT sum(nulls) AS nulls, max(n_rows) AS r, count(*) AS c, count(*) FILTER (nulls > 0) AS wn, count(*) FILTER (is_pii) AS np, coalesce(string_agg(col, ', ' ORDER BY ordinal) FILTER (is_pii), '') AS pc FROM prof),
parts AS (SELECT (1 - CAST(nulls AS DOUBLE) / (r * c)) * 100 AS co, (1 - CAST(d AS DOUBLE) / r) * 100 AS un, (1 - CAST(wn AS DOUBLE) / c) * 100 AS qu, greatest(0.0, 100.0 - np * 25) AS pr, d, wn, np, pc FROM sums, dups),
health AS (SELECT CAST(round_even(CAST(0.35 * co + 0.25 * un + 0.25 * qu + 0.15 * pr AS DOUBLE), 0) AS INTEGER) AS score, round_even(CAST(co AS DOUBLE), 1) AS co, round_even(CAST(un AS DOUBLE), 1) AS un, round_even(CAST(qu AS DOUBLE), 1) AS qu, CAST(pr AS DOUBLE) AS pr, d, wn, np, pc FROM parts),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM health)
"""


def parts(spark, sf):
    df = dirty_orders(spark, sf)
    return p.profile(df).cache(), h.duplicate_rows(df)  # a row a column; several parts read it


def health_row(spark, sf):
    return h.health(*parts(spark, sf))


def card_rows(spark, sf):
    return h.cards(h.health(*parts(spark, sf)))


def issue_rows(spark, sf):
    return h.issues(*parts(spark, sf))


def report_rows(spark, sf):
    """The whole report as rows (part, name, value)."""
    r = h.report(dirty_orders(spark, sf))
    rows = lambda df, part, name, value: df.select(F.lit(part).alias("part"), F.expr(name).alias("name"), F.expr(value).alias("value"))
    out = rows(r.health, "health", "grade", "cast(score as string)")
    for more in (
        rows(r.profile, "profile", "column", "concat(sql_type, ' ', cast(nulls as string), ' ', cast(n_distinct as string))"), rows(r.cards, "card", "label", "status"), rows(r.issues, "issue", "id", "severity"),
        rows(r.primary_key, "key", "column", "'primary'"), rows(r.indexes, "index", "column", "kind"), rows(r.declarations, "declaration", "declaration", "cast(is_key as string)"), rows(r.rules, "rule", "name", "condition"),
    ):
        out = out.unionByName(more)
    return out


def listed(spark, sf):
    """The schema, and how many values each column has."""
    df = table(spark, sf, "orders")
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    counts = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in df.columns])).alias("x")).select("x.*")
    return p.schema_list(df).join(F.broadcast(counts), "column").select("ordinal", "column", "dtype", "filled")


def duplicates(by_hash):
    return lambda spark, sf: h.duplicate_rows(dirty_orders(spark, sf), by_hash).select(F.col("duplicates").cast("long").alias("duplicates"))


def key_of(name):
    sql = with_profile(name) + "SELECT col AS \"column\" FROM prof WHERE is_pk_candidate ORDER BY ends_with(lower(col), 'id') DESC, ordinal LIMIT 1"
    return (lambda spark, sf: h.primary_key(p.profile(frame(spark, sf, name)))), sql


PK = ", pk AS (SELECT col AS pk FROM prof WHERE is_pk_candidate ORDER BY ends_with(lower(col), 'id') DESC, ordinal LIMIT 1) "


def rule_null_rate(spark, sf):
    old, new = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderstatus")).alias("status")), dirty_orders(spark, sf).select("status")
    return rules.null_rate(p.profile(old), p.profile(new))


def column_facts(spark, sf):
    return p.column_facts(table(spark, sf, "events"), "event_type", "event_id")


def freshness(spark, sf):
    return rules.freshness(table(spark, sf, "events"), "ts", "2025-01-01 00:00:00")


def volume(spark, sf):
    out = rules.volume_drops(table(spark, sf, "events"), "ts")
    return out.withColumn("usual", F.round("usual", 6))


def loads(spark, sf, name, moment):
    """A store of a table's loads, each read once: one for each weekday of the moment."""
    df, store = frame(spark, sf, name), state.StateStore(spark, f"{scratch(spark)}/state")
    for day in range(1, 8):
        store.add(f"day{day}", df.where(F.dayofweek(moment) == day))
    return store


def state_profile(spark, sf):
    out = state.profile_of(loads(spark, sf, "orders", "o_orderdate").columns())
    return out.select("ordinal", "column", "nulls", "null_pct", "sql_type", "is_pii", "date_like", "number_like")


def state_numbers(spark, sf):
    out = state.numbers(loads(spark, sf, "orders", "o_orderdate").columns())
    return out.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


def state_volume(spark, sf):
    days = loads(spark, sf, "events", "ts").days().where("column = 'ts'").select("day", "n")
    return rules.drops_of(days).withColumn("usual", F.round("usual", 6))


def state_freshness(spark, sf):
    return state.freshness(loads(spark, sf, "events", "ts").columns(), "ts", "2025-01-01 00:00:00")


def state_null_rate(spark, sf):
    """A new load of the dirty orders against the state of a load with fewer missing statuses; only states are compared."""
    store = state.StateStore(spark, f"{scratch(spark)}/state")
    store.add("old", table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderstatus")).alias("status")))
    store.add("new", dirty_orders(spark, sf).select("status"))
    return rules.null_rate(state.null_rates(store.columns("old")), state.null_rates(store.columns("new")))


def outliers(spark, sf):
    return rules.outliers(table(spark, sf, "events"), ["value"]).select("event_id", "outlier_columns")


def summary(spark, sf):
    out = p.numeric_summary(table(spark, sf, "part"))
    return out.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def first_sample(spark, sf):
    """The rules on first values: 20, 50 and 30 texts in order of the key."""
    return p.profile(table(spark, sf, "documents"), sample_order="doc_id").where("class = 'text'").select("column", "is_pii", "date_like", "number_like")


SUMMARY = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM part"
    for c in ("p_partkey", "p_size", "p_retailprice")
)
FIRSTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", regexp_matches('{c}', '{"|".join(p.PII_WORDS)}') OR (count(*) FILTER ({sql_moment('v')} IS NOT NULL) < 0.8 * count(*) AND count(*) FILTER (k <= 20 AND (regexp_matches(v, '{EMAIL}') OR regexp_matches(v, '{PHONE}'))) >= greatest(3, least(count(*), 20) // 2)) AS is_pii,
    count(*) FILTER ({sql_moment('v')} IS NOT NULL) >= 0.8 * count(*) AS date_like, count(*) FILTER (k <= 30 AND regexp_full_match(trim(v), '-?[0-9]+([.][0-9]+)?')) >= 0.8 * least(count(*), 30) AS number_like
    FROM (SELECT {c} AS v, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE {c} IS NOT NULL) WHERE k <= 50"""
    for c in ("text", "lang", "source")
)
#: Labels, details and actions, stated for the SQL by themselves.
CARDS = with_profile("dirty") + ", " + HEALTH + """SELECT 1 AS position, 'Health score' AS label, score || '/100 (' || grade || ')' AS value, CASE WHEN score >= 90 THEN 'good' WHEN score >= 75 THEN 'warn' ELSE 'bad' END AS status, 'Weighted data-quality score.' AS detail FROM graded
    UNION ALL SELECT 2, 'Completeness', co || '%', CASE WHEN co >= 98 THEN 'good' WHEN co >= 90 THEN 'warn' ELSE 'bad' END, 'Share of non-null cells.' FROM health
    UNION ALL SELECT 3, 'Duplicate rows', CAST(d AS VARCHAR), CASE WHEN d = 0 THEN 'good' WHEN d <= 2 THEN 'warn' ELSE 'bad' END, 'Fully duplicated rows.' FROM health
    UNION ALL SELECT 4, 'Cols with nulls', CAST(wn AS VARCHAR), CASE WHEN wn = 0 THEN 'good' WHEN wn <= 2 THEN 'warn' ELSE 'bad' END, 'Columns containing missing values.' FROM health
    UNION ALL SELECT 5, 'PII columns', CAST(np AS VARCHAR), CASE WHEN np = 0 THEN 'good' WHEN np <= 1 THEN 'warn' ELSE 'bad' END, CASE WHEN np = 0 THEN 'No obvious PII detected.' ELSE pc END FROM health"""
ISSUES = with_profile("dirty") + ", " + DUPLICATES.format("dirty") + """SELECT 'nulls_' || col AS id, CASE WHEN null_pct >= 20 THEN 'High' WHEN null_pct >= 5 THEN 'Medium' ELSE 'Low' END AS severity, nulls AS count, 'Fill with default / drop rows' AS action, 'Missing values: ' || col AS title, null_pct || '% of the values are missing' AS detail FROM prof WHERE null_pct > 0
    UNION ALL SELECT 'pii_' || col, 'High', n_distinct, 'Mask / anonymize before storing', 'Personal data: ' || col, 'its name or its values look personal' FROM prof WHERE is_pii UNION ALL SELECT 'dup_rows', CASE WHEN d <= 2 THEN 'Medium' ELSE 'High' END, d, 'Drop duplicates', 'Repeated rows', d || ' rows occur again' FROM dups WHERE d > 0
    UNION ALL SELECT 'cast_' || col, 'Low', num, 'Cast to a numeric type', 'Numbers kept as text: ' || col, num || ' values read as numbers' FROM prof WHERE number_like"""


def rules_sql(name):
    return with_profile(name) + """, pk AS (SELECT col AS pk FROM prof WHERE is_pk_candidate ORDER BY ends_with(lower(col), 'id') DESC, ordinal LIMIT 1), rules AS (
    SELECT 'Null rate: ' || col AS name, 'Completeness' AS type, CASE WHEN null_pct >= 20 THEN 'High' ELSE 'Medium' END AS severity, 'null_rate(' || col || ') > ' || CAST(greatest(1, CAST(round_even(null_pct, 0) AS INTEGER)) AS VARCHAR) || '%' AS condition FROM prof WHERE null_pct > 0
    UNION ALL SELECT 'Duplicate key: ' || pk, 'Uniqueness', 'High', 'COUNT(*) > COUNT(DISTINCT ' || pk || ')' FROM pk
    UNION ALL SELECT * FROM (SELECT 'Freshness: ' || col, 'Timeliness', 'Medium', 'MAX(' || col || ') < TODAY - 2 days' FROM prof WHERE sql_type = 'DATETIME2' ORDER BY ordinal LIMIT 1)
    UNION ALL SELECT 'Row volume drop', 'Volume', 'Medium', 'daily_row_count < 0.5 * 7day_avg'
    UNION ALL SELECT * FROM (SELECT 'Outliers: ' || col, 'Validity', 'Low', col || ' outside mean +/- 3*stddev' FROM prof WHERE kind IN ('i', 'n') AND NOT ends_with(lower(col), 'id') ORDER BY ordinal LIMIT 1))
    SELECT *, CASE type WHEN 'Completeness' THEN 'later loads may miss more values than this one' WHEN 'Uniqueness' THEN 'a key names one row' WHEN 'Timeliness' THEN 'new rows should keep coming'
      WHEN 'Volume' THEN 'a load may have been cut short' ELSE 'values far from the usual ones are often errors' END AS rationale FROM rules"""


REPORT = f"""SELECT 'health' AS part, grade AS name, CAST(score AS VARCHAR) AS value FROM ({with_profile("dirty")}, {HEALTH} SELECT * FROM graded)
    UNION ALL SELECT 'profile', col, sql_type || ' ' || nulls || ' ' || n_distinct FROM ({with_profile("dirty")} SELECT * FROM prof)
    UNION ALL SELECT 'card', label, status FROM ({CARDS}) UNION ALL SELECT 'issue', id, severity FROM ({ISSUES})
    UNION ALL SELECT 'key', pk, 'primary' FROM ({with_profile("dirty")}{PK} SELECT pk FROM pk)
    UNION ALL SELECT 'index', col, CASE WHEN col = pk THEN 'primary_key' WHEN ends_with(lower(col), 'id') THEN 'foreign_key_like' ELSE 'date' END FROM ({with_profile("dirty")}{PK} SELECT * FROM prof LEFT JOIN pk ON true) WHERE col = pk OR ends_with(lower(col), 'id') OR kind = 'd'
    UNION ALL SELECT 'declaration', col || ' ' || sql_type || CASE WHEN nulls = 0 THEN ' NOT NULL' ELSE ' NULL' END, CASE WHEN col = pk THEN 'true' ELSE 'false' END FROM ({with_profile("dirty")}{PK} SELECT * FROM prof LEFT JOIN pk ON true)
    UNION ALL SELECT 'rule', name, condition FROM ({rules_sql("dirty")})"""
NULL_RATE = f"""WITH {DIRTY}, o AS (SELECT round_even(CAST(100.0 * count(*) FILTER (o_orderkey % 20 = 0 OR o_orderstatus IS NULL) / count(*) AS DOUBLE), 1) AS b FROM orders), n AS (SELECT round_even(CAST(100.0 * (count(*) - count(status)) / count(*) AS DOUBLE), 1) AS c FROM dirty)
        SELECT 'status' AS "column", b AS baseline_pct, c AS null_pct, greatest(1, CAST(round_even(b, 0) AS INTEGER)) AS limit_pct, c > greatest(1, CAST(round_even(b, 0) AS INTEGER)) AS broken FROM o, n"""
FRESHNESS = "SELECT max(ts) AS latest, max(ts) < TIMESTAMP '2025-01-01 00:00:00' - INTERVAL 2 DAY AS broken FROM events"
VOLUME = """WITH e AS (SELECT CAST(ts AS DATE) AS day FROM events), c AS (SELECT day, count(*) AS n FROM e GROUP BY 1),
        s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day), f AS (SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.day = c.day),
        w AS (SELECT day, n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS usual FROM f) SELECT day, n, round(usual, 6) AS usual, coalesce(n < 0.5 * usual, false) AS broken FROM w"""
ENTRIES = {
    **{f"profile_{n}": profile_of(n) for n in TABLES},
    **{f"profile_screened_{n}": screened(n) for n in ("lineitem", "documents", "dirty")},
    "profile_first_values": (first_sample, FIRSTS),
    "pii_columns": (lambda s, d: p.profile(table(s, d, "customer").unionByName(table(s, d, "supplier"), allowMissingColumns=True)).select("column", "is_pii"),
        "SELECT col AS \"column\", regexp_matches(col, 'name') OR regexp_matches(col, 'mail') AS is_pii FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment'), ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal')) v(col)"),
    "pii_values": (lambda s, d: p.personal_rows(table(s, d, "documents"), "text").select("doc_id"),
        f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PHONE}')"),
    "date_like": (lambda s, d: p.profile(dirty_orders(s, d).select("order_date", "status")).select("column", "date_like"), with_profile("dirty") + "SELECT col AS \"column\", date_like FROM prof WHERE col IN ('order_date', 'status')"),
    "numeric_like": (lambda s, d: p.profile(table(s, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("q"), "l_returnflag")).select("column", "number_like"), "SELECT * FROM (VALUES ('q', true), ('l_returnflag', false)) v(\"column\", number_like)"),
    "column_facts": (column_facts, """WITH f AS (SELECT event_type AS v, min(event_id) AS pos FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY pos, v LIMIT 5)
        SELECT 'string' AS dtype, (SELECT count(DISTINCT event_type) FROM events) AS n_distinct, (SELECT count(*) - count(event_type) FROM events) AS nulls, string_agg(v, ', ' ORDER BY pos, v) AS first_values FROM f"""),
    "overview": (lambda s, d: p.overview(table(s, d, "orders")), "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, CAST(4 AS BIGINT) AS n_dtypes FROM orders"),
    "nulls_by_column": (lambda s, d: p.nulls_by_column(p.profile(dirty_orders(s, d))), with_profile("dirty") + "SELECT col AS \"column\", nulls, CAST(null_pct AS DOUBLE) AS null_pct FROM prof WHERE nulls > 0"),
    "schema_list": (listed, "WITH d AS (SELECT * FROM (DESCRIBE orders)), n AS (UNPIVOT (SELECT " + ", ".join(f"count({c}) AS {c}" for c, _ in COLUMNS["orders"]) + " FROM orders) ON * INTO NAME col VALUE filled), k AS (SELECT row_number() OVER () - 1 AS ordinal, column_name, column_type FROM d) SELECT CAST(ordinal AS INTEGER) AS ordinal, col AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS dtype, filled FROM n JOIN k ON col = column_name"),
    "shown_profile": (lambda s, d: p.shown_profile(p.profile(table(s, d, "labels"))), with_profile("labels") + "SELECT col AS \"column\", CASE col WHEN 'doc_id' THEN 'bigint' ELSE 'int' END AS dtype, n_distinct AS \"unique\", nulls AS missing FROM prof"),
    "numeric_summary": (summary, SUMMARY),
    "duplicate_rows": (duplicates(False), f"WITH {DIRTY}, {DUPLICATES.format('dirty')} SELECT CAST(d AS BIGINT) AS duplicates FROM dups"),
    "duplicate_rows_by_hash": (duplicates(True), f"WITH {DIRTY}, {DUPLICATES.format('dirty')} SELECT CAST(d AS BIGINT) AS duplicates FROM dups"),
    "health": (health_row, with_profile("dirty") + ", " + HEALTH + "SELECT score, grade, co AS completeness_pct, un AS uniqueness_pct, qu AS column_quality_pct, pr AS privacy_score, d AS duplicate_rows, wn AS columns_with_nulls, np AS n_pii, pc AS pii_columns FROM graded"),
    "cards": (card_rows, CARDS), "issues": (issue_rows, ISSUES), "health_report": (report_rows, REPORT),
    "pk_pick_orders": key_of("orders"), "pk_pick_events": key_of("events"), "pk_pick_documents": key_of("documents"), "pk_pick_dirty": key_of("dirty"),
    "index_hints": (lambda s, d: h.index_hints(p.profile(table(s, d, "events"))).select("column", "kind"), with_profile("events") + PK + "SELECT col AS \"column\", CASE WHEN col = pk THEN 'primary_key' WHEN ends_with(lower(col), 'id') THEN 'foreign_key_like' ELSE 'date' END AS kind FROM prof, pk WHERE col = pk OR ends_with(lower(col), 'id') OR kind = 'd'"),
    "column_decls": (lambda s, d: h.column_declarations(p.profile(table(s, d, "events"))), with_profile("events") + PK + "SELECT CAST(ordinal AS INTEGER) AS ordinal, col || ' ' || sql_type || CASE WHEN nulls = 0 THEN ' NOT NULL' ELSE ' NULL' END AS declaration, col = pk AS is_key FROM prof, pk"),
    "rule_rows": (lambda s, d: h.rule_rows(p.profile(dirty_orders(s, d)).cache()), rules_sql("dirty")), "rule_rows_events": (lambda s, d: h.rule_rows(p.profile(table(s, d, "events")).cache()), rules_sql("events")),
    "rule_null_rate": (rule_null_rate, NULL_RATE),
    "rule_dup_key": (lambda s, d: rules.duplicate_keys(dirty_orders(s, d), "order_id"), f"WITH {DIRTY} SELECT order_id AS key, count(*) AS n FROM dirty GROUP BY 1 HAVING count(*) > 1"),
    "rule_key_unique": (lambda s, d: rules.key_is_unique(dirty_orders(s, d), "order_id"), f"WITH {DIRTY} SELECT count(*) AS n_rows, count(DISTINCT order_id) AS n_distinct, count(*) > count(DISTINCT order_id) AS broken FROM dirty"),
    "rule_freshness": (freshness, FRESHNESS),
    "rule_volume": (volume, VOLUME),
    "state_profile": (state_profile, with_profile("orders") + 'SELECT CAST(ordinal AS INTEGER) AS ordinal, col AS "column", nulls, CAST(null_pct AS DOUBLE) AS null_pct, sql_type, is_pii, date_like, number_like FROM prof'),
    "state_numbers": (state_numbers, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice"))),
    "state_rule_volume": (state_volume, VOLUME), "state_rule_freshness": (state_freshness, FRESHNESS), "state_rule_null_rate": (state_null_rate, NULL_RATE),
    "rule_outlier": (outliers, "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT event_id, 'value' AS outlier_columns FROM events, s WHERE abs(value - m) > 3 * d"),
}
