"""Request-log queries: the messages of the conversations table, asked of a table's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.inputs import money, table
from tidemark.operators import requests as r
from tidemark.operators.dashboard import column_roles
from tidemark.operators.profile import profile

#: What users ask, so that all rules have something to match.
PHRASES = ["top 3 o_orderstatus as pie chart", "average o_totalprice by o_orderpriority", "ventas mensuales en barras", "what is the total o_totalprice", "o_totalprice by o_orderstatus no graph", "weekly sales as a line", "o_totalpricee by status", "hello", "top 2 o_totalprice by o_orderpriority as a bar chart", "o_totalprice by o_orderdate as line"]


def asked(spark, sf):
    """(msg_id, text): every turn of the conversations as it is, and for each turn of a user one of the phrases (negative ids)."""
    said = table(spark, sf, "conversations")
    # A log is a small file of much work: one row group would be one task.
    said = said.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    id = F.col("conv_id") * 1000 + F.col("turn")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (id % len(PHRASES) + 1).cast("int"))
    return said.select(id.alias("msg_id"), "text").unionByName(said.where("role = 'user'").select((-id - 1).alias("msg_id"), phrase.alias("text")))


LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
ASKED = f"""a AS (SELECT conv_id * 1000 + turn AS msg_id, text FROM conversations
  UNION ALL SELECT -(conv_id * 1000 + turn) - 1, {LIST}[CAST((conv_id * 1000 + turn) % {len(PHRASES)} + 1 AS INTEGER)] FROM conversations WHERE role = 'user'),
f AS (SELECT msg_id, trim(text) AS text, strip_accents(lower(trim(text))) AS t FROM a)"""


def orders(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_totalprice", money("o_totalprice"))
    return df, column_roles(profile(df)).cache()


def intents(spark, sf):
    return r.intents(asked(spark, sf)).select("msg_id", "named_type", "top", "ranking", "average", "sales", "timely", "time_grain", "chart")


#: The same words, stated for the SQL by themselves: a single word or a run of words of the folded text.
SQL_WORDS = {
    "pie": "pie pastel torta circular", "line": "line trend over_time linea lineas tendencia", "bar": "bar barra barras",
    "ranking": "top most highest largest best leading biggest mejor mejores mayor mayores mas principales primero primeros",
    "average": "average avg mean promedio media medio",
    "sales": "selling sold sell sells sales revenue earn earns earning earnings profit profits profitable money dinero venta ventas ingreso ingresos",
    "year": "yearly annual annually per_year by_year anual anuales por_ano", "quarter": "quarterly per_quarter by_quarter trimestral trimestrales por_trimestre",
    "month": "monthly per_month by_month mensual mensuales por_mes", "week": "weekly per_week by_week semanal semanales por_semana", "day": "daily per_day by_day diario diaria diarios diarias por_dia",
    "time": "over_time trend time_series timeseries by_date by_time por_fecha en_el_tiempo tendencia evolucion fecha date",
    "chart": "chart graph plot visualize visualise visualizacion visualisacion draw show_me_a grafica graficas grafico graficos graficar diagrama barra barras pastel torta linea lineas",
    "no_chart": "no_graph no_chart no_grafica no_grafico sin_grafica sin_grafico just_the_number just_the_total just_the_answer only_the_number only_the_total solo_el_numero solo_el_total",
    "question": "what_is what's whats what_are how_much how_many tell_me cuanto cuantos cual_es cuales_son que_es dime", "status": "status state estado",
}


def said(*names):
    """Whether the text has one of the words: t between marks, in which every run of other characters is one mark."""
    return "(" + " OR ".join(f"contains(m, '|{w.replace(chr(39), '|').replace('_', '|')}|')" for n in names for w in SQL_WORDS[n].split()) + ")"


def sql_case(*names):
    return "CASE " + " ".join(f"WHEN {said(n)} THEN '{n}'" for n in names) + " END"


INTENTS = f"""WITH {ASKED}, k AS (SELECT *, '|' || regexp_replace(t, '[^a-z0-9_]+', '|', 'g') || '|' AS m FROM f)
SELECT msg_id, {sql_case('pie', 'line', 'bar')} AS named_type, CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])top\\s+[0-9]{{1,2}}($|[^a-z0-9_])') THEN CAST(regexp_extract(t, '(?:^|[^a-z0-9_])top\\s+([0-9]{{1,2}})(?:$|[^a-z0-9_])', 1) AS INTEGER) WHEN {said('ranking')} THEN 10 END AS top,
  {said('ranking')} AS ranking, {said('average')} AS average, {said('sales')} AS sales, {said('time', 'year', 'quarter', 'month', 'week', 'day')} AS timely, {sql_case('year', 'quarter', 'month', 'week', 'day')} AS time_grain,
  NOT {said('no_chart')} AND ({said('chart')} OR NOT {said('question')}) AS chart FROM k"""


def resolved(spark, sf):
    return r.confirmation(r.resolve(asked(spark, sf), orders(spark, sf)[1]))


def strict(spark, sf):
    return r.strict(asked(spark, sf), orders(spark, sf)[1])


STRICT = f"""WITH {ASKED}, s AS (SELECT * FROM (VALUES ('{PHRASES[0]}', 'pie', 'o_orderstatus', NULL, 'count', 3), ('{PHRASES[8]}', 'bar', 'o_orderpriority', 'o_totalprice', 'sum', 2), ('{PHRASES[9]}', 'line', 'o_orderdate', 'o_totalprice', 'sum', NULL)) v(text, chart_type, dimension, measure, agg, top_n))
SELECT msg_id, chart_type, dimension, measure, agg, CAST(top_n AS INTEGER) AS top_n FROM f JOIN s USING (text)"""


def phrased(spark, sf):
    """(msg_id, text): for each turn of a user one of the phrases."""
    return asked(spark, sf).where("msg_id < 0")


def resolved_phrases(spark, sf):
    return r.confirmation(r.resolve(phrased(spark, sf), orders(spark, sf)[1]))


def mentioned_phrases(spark, sf):
    return r.mentions(phrased(spark, sf), orders(spark, sf)[1]).select("msg_id", "column", "at")


def answered_phrases(spark, sf):
    """The data of all phrases, loose ones too: three axes, two grains, sums, means and counts, from one read of the orders."""
    df, catalog = orders(spark, sf)
    out = r.answers(df, r.resolve(phrased(spark, sf), catalog))
    return out.withColumn("value", F.round("value", 4))


#: What each phrase means, in the order of the phrases.
MEANT = [
    ("chart", "pie", "o_orderstatus", None, "count", 3, None, "Added: row count by top 3 **o_orderstatus**, as a **pie** chart."),
    ("chart", "bar", "o_orderpriority", "o_totalprice", "mean", None, None, "Added: average **o_totalprice** by **o_orderpriority**, as a **bar** chart."),
    ("chart", "bar", "o_orderdate", "o_totalprice", "sum", None, "month", "Added: total **o_totalprice** by **o_orderdate** per month, as a **bar** chart."),
    ("scalar", None, None, "o_totalprice", "sum", None, None, None),
    ("answer", "bar", "o_orderstatus", "o_totalprice", "sum", None, None, "Added: total **o_totalprice** by **o_orderstatus**, as a **bar** chart."),
    ("chart", "line", "o_orderdate", "o_totalprice", "sum", None, "week", "Added: total **o_totalprice** by **o_orderdate** per week, as a **line** chart."),
    ("chart", "bar", "o_orderstatus", "o_totalprice", "sum", None, None, "Added: total **o_totalprice** by **o_orderstatus**, as a **bar** chart."),
    ("none", None, None, None, None, None, None, None),
    ("chart", "bar", "o_orderpriority", "o_totalprice", "sum", 2, None, "Added: total **o_totalprice** by top 2 **o_orderpriority**, as a **bar** chart."),
    ("chart", "line", "o_orderdate", "o_totalprice", "sum", None, None, "Added: total **o_totalprice** by **o_orderdate**, as a **line** chart."),
]


def literal(v):
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


MEANINGS = "(VALUES " + ", ".join(f"({literal(t)}, {', '.join(map(literal, m))})" for t, m in zip(PHRASES, MEANT)) + ") v(text, resolved, chart_type, dimension, measure, agg, top_n, grain, confirmation)"


def mentioned(spark, sf):
    return r.mentions(asked(spark, sf), orders(spark, sf)[1]).select("msg_id", "column", "at")


def synonyms(spark, sf):
    return r.synonym_dimensions(asked(spark, sf), orders(spark, sf)[1])


def proposals(spark, sf):
    """Every text as a proposal, as it is, and for each one in JSON (negative ids)."""
    said = asked(spark, sf).where("msg_id >= 0")
    id = F.col("msg_id")
    body = F.to_json(F.struct(
        F.when(id % 5 == 0, "supplier").when(id % 5 == 1, "o_orderdate").otherwise("o_orderstatus").alias("dimension"), F.when(id % 3 == 0, "profit").otherwise("o_totalprice").alias("measure"),
        F.when(id % 4 == 0, "donut").otherwise("pie").alias("chart_type"), F.when(id % 7 == 0, "median").otherwise("mean").alias("agg"), (id % 60).alias("top_n"), F.lit("week").alias("grain"),
    ))
    made = said.select((-id - 1).alias("msg_id"), F.concat(F.lit("```json\n"), body, F.lit("\n``` thanks")).alias("text"))
    return r.validate_json(said.unionByName(made), orders(spark, sf)[1])


PROPOSALS = """WITH p AS (SELECT conv_id * 1000 + turn AS i FROM conversations)
SELECT i AS msg_id, false AS accepted, NULL AS chart_type, NULL AS dimension, NULL AS measure, NULL AS agg, NULL AS top_n, NULL AS grain FROM p
UNION ALL SELECT -i - 1, i % 5 <> 0, CASE WHEN i % 5 <> 0 THEN CASE WHEN i % 4 = 0 THEN 'bar' ELSE 'pie' END END AS chart_type,
  CASE WHEN i % 5 = 0 THEN NULL WHEN i % 5 = 1 THEN 'o_orderdate' ELSE 'o_orderstatus' END AS dimension, CASE WHEN i % 5 <> 0 AND i % 3 <> 0 THEN 'o_totalprice' END AS measure,
  CASE WHEN i % 5 = 0 THEN NULL WHEN i % 3 = 0 THEN 'count' WHEN i % 7 = 0 THEN 'sum' ELSE 'mean' END AS agg, CASE WHEN i % 5 <> 0 AND i % 60 BETWEEN 1 AND 50 THEN CAST(i % 60 AS INTEGER) END AS top_n, CASE WHEN i % 5 = 1 THEN 'week' END AS grain FROM p"""


def answered(spark, sf):
    """The data of all requests in the strict form, of three types."""
    df, catalog = orders(spark, sf)
    return r.answers(df, r.strict(asked(spark, sf), catalog).withColumn("grain", F.lit(None).cast("string")))


_SUM = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
ANSWERS = f"""WITH {ASKED}, top AS (SELECT '{PHRASES[0]}' AS text, o_orderstatus AS x, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3),
two AS (SELECT '{PHRASES[8]}' AS text, o_orderpriority AS x, {_SUM} AS value FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 2),
days AS (SELECT '{PHRASES[9]}' AS text, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS x, {_SUM} AS value FROM orders GROUP BY 2)
SELECT msg_id, x, value FROM f JOIN (SELECT * FROM top UNION ALL SELECT * FROM two UNION ALL SELECT * FROM days) USING (text)"""
RESOLVED = f"WITH {ASKED} SELECT msg_id, resolved, chart_type, dimension, measure, agg, CAST(top_n AS INTEGER) AS top_n, grain, confirmation FROM f JOIN {MEANINGS} USING (text) WHERE msg_id < 0"
#: A column's whole name in a phrase, or the near-spelling of one; `status` and `total` are parts of names.
MENTIONED = f"""WITH {ASKED}, c AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS col),
p AS (SELECT DISTINCT text, t FROM f WHERE msg_id < 0), w AS (SELECT text, t, unnest(regexp_extract_all(t, '[a-z0-9_]{{3,}}')) AS word FROM p),
hit AS (SELECT text, col, instr(t, col) AS pos, 0 AS rule FROM p, c WHERE instr(t, col) > 0
  UNION ALL SELECT text, col, min(instr(t, word)), 1 FROM w, c WHERE contains(col, word) OR (word = 'o_totalpricee' AND col = 'o_totalprice') GROUP BY 1, 2),
best AS (SELECT text, col, arg_min(pos, rule) AS pos FROM hit GROUP BY 1, 2)
SELECT msg_id, col AS "column", CAST(pos AS INTEGER) AS at FROM f JOIN best USING (text) WHERE msg_id < 0 AND col IN (SELECT col FROM c)"""
_MEAN = "round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice), 4)"
_SETS = {
    0: "SELECT o_orderstatus AS x, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", 1: f"SELECT o_orderpriority AS x, {_MEAN} AS value FROM orders GROUP BY 1",
    2: f"SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS x, round({_SUM}, 4) AS value FROM orders GROUP BY 1", 4: f"SELECT o_orderstatus AS x, round({_SUM}, 4) AS value FROM orders GROUP BY 1",
    5: f"SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d %H:%M:%S') AS x, round({_SUM}, 4) AS value FROM orders GROUP BY 1", 6: f"SELECT o_orderstatus AS x, round({_SUM}, 4) AS value FROM orders GROUP BY 1",
    8: f"SELECT o_orderpriority AS x, round({_SUM}, 4) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2", 9: f"SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS x, round({_SUM}, 4) AS value FROM orders GROUP BY 1",
}
ALL_ANSWERS = f"WITH {ASKED} SELECT msg_id, x, value FROM f JOIN (" + " UNION ALL ".join(f"SELECT '{PHRASES[i]}' AS text, * FROM ({q})" for i, q in _SETS.items()) + ") USING (text) WHERE msg_id < 0"
ENTRIES = {
    "tag_resolve_phrases": (resolved_phrases, RESOLVED), "tag_columns_phrases": (mentioned_phrases, MENTIONED), "tag_answers_phrases": (answered_phrases, ALL_ANSWERS),
    "tag_intents": (intents, INTENTS), "tag_strict": (strict, STRICT), "tag_validate_json": (proposals, PROPOSALS), "tag_answers": (answered, ANSWERS),
    "tag_synonyms": (synonyms, f"WITH {ASKED} SELECT msg_id, 'o_orderstatus' AS synonym FROM (SELECT *, '|' || regexp_replace(t, '[^a-z0-9_]+', '|', 'g') || '|' AS m FROM f) WHERE {said('status')}"),
    "tag_columns": (mentioned, None), "tag_resolve": (resolved, None),  # near-spellings need a sequence ratio; see tests/test_requests.py
}
