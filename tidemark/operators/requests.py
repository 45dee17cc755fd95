"""Tagging of a log of plain-language chart requests.

Input are a table of messages (msg_id, text) and a catalog (column, role, ordinal) with one row for each column
of the table asked about; the catalog is small by nature and is broadcast after a check of its size. Output is
one resolved request a message. Keyword tests run on text without accents.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.text import folded
from tidemark.functions.types import DATE, type_class
from tidemark.operators.charts import GRAINS, grouped_many
from tidemark.operators.dashboard import PRIORITY

MAX_CATALOG = 10_000
MAX_WORDS = 200_000
DEFAULT_TOP = 10
SIMILAR = 0.82
GAP = "[^a-z0-9_]+"


def any_of(phrases: str) -> str:
    """A pattern for any of the phrases (between commas) as whole words; a star stands for any ending.

    Between words stands whatever is no letter a-z, digit or underline; what `\\b` takes for a letter differs between Java versions.
    """
    parts = (p.strip().replace(" ", GAP).replace("'", GAP).replace("*", "[a-z0-9_]*") for p in phrases.split(","))
    return "(?<![a-z0-9_])(" + "|".join(parts) + ")(?![a-z0-9_])"


#: Words of requests in English and Spanish, without accents.
TYPES = {"pie": any_of("pie, pastel, torta, circular"), "line": any_of("line, trend, over time, linea, lineas, tendencia"), "bar": any_of("bar, barra, barras")}
RANKING = any_of("top, most, highest, largest, best, leading, biggest, mejor, mejores, mayor, mayores, mas, principales, primero, primeros")
SALES = any_of("selling, sold, sell, sells, sales, revenue, earn, earns, earning, earnings, profit, profits, profitable, money, dinero, venta, ventas, ingreso, ingresos")
AVERAGE = any_of("average, avg, mean, promedio, media, medio")
GRAIN = {
    "year": any_of("yearly, annual, annually, per year, by year, anual, anuales, por ano"),
    "quarter": any_of("quarterly, per quarter, by quarter, trimestral, trimestrales, por trimestre"),
    "month": any_of("monthly, per month, by month, mensual, mensuales, por mes"),
    "week": any_of("weekly, per week, by week, semanal, semanales, por semana"),
    "day": any_of("daily, per day, by day, diario, diaria, diarios, diarias, por dia"),
}
TIME = "|".join([*GRAIN.values(), any_of("over time, trend, time series, timeseries, by date, by time, por fecha, en el tiempo, tendencia, evolucion, fecha, date")])
CHART = any_of(
    "chart, graph, plot, visualize, visualise, visualizacion, visualisacion, draw, show me a, grafica, graficas, grafico, graficos, graficar, diagrama, barra, barras, pastel, torta, linea, lineas"
)
NO_CHART = any_of(
    "no graph, no chart, no grafica, no grafico, sin grafica, sin grafico, just the number, just the total, just the answer, only the number, only the total, solo el numero, solo el total"
)
QUESTION = any_of("what is, what's, whats, what are, how much, how many, tell me, cuanto, cuantos, cual es, cuales son, que es, dime")
#: Business words, and the parts of column names they stand for, in order of preference.
SYNONYMS = [
    (any_of("seller, sellers, selling, salespeople, sales rep, sales reps, salesrep, salesreps, vendedor, vendedores, vendedora, vendedoras"), ("seller", "salesperson", "sales_rep", "rep", "agent", "vendedor")),
    (any_of("store, stores, shop, shops, branch, branches, location, locations, outlet, outlets, tienda, tiendas, sucursal, sucursales, local, locales"), ("store", "shop", "branch", "location", "outlet", "tienda", "sucursal")),
    (any_of("product, products, item, items, sku, skus, producto, productos, articulo, articulos"), ("product", "item", "sku", "producto")),
    (any_of("customer, customers, client, clients, buyer, buyers, cliente, clientes, comprador, compradores"), ("customer", "client", "buyer", "cliente")),
    (any_of("region, regions, regiones, area, areas, zone, zones, zona, zonas, territor*"), ("region", "area", "zone", "territory", "zona")),
    (any_of("categor*, tipo, tipos"), ("category", "type", "categoria")),
    (any_of("countr*, pais"), ("country", "pais")),
    (any_of("holiday, holidays, festivo, festivos, feriado, feriados, vacaciones"), ("holiday", "festivo")),
    (any_of("status, state, estado"), ("status", "state", "estado")),
]
STRICT = r"(?is)^(.*)\bas\s+(?:an?\s+)?(pie|bar|line)(?:\s+chart)?\s*\z"
TOP = r"(?i)\btop\s+(\d{1,2})\b"
FOLDED_TOP = r"(?<![a-z0-9_])top[ \t\n\f\r]+([0-9]{1,2})(?![a-z0-9_])"

REQUEST = ("resolved", "chart_type", "dimension", "measure", "agg", "top_n", "grain")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def first_of(text: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(has(text, p), name) for name, p in patterns.items()])


def top_n(text: Column) -> Column:
    stated = F.regexp_extract(text, FOLDED_TOP, 1)
    return F.when(stated != "", stated.try_cast("int")).when(has(text, RANKING), DEFAULT_TOP)


def wants_chart(text: Column) -> Column:
    return ~has(text, NO_CHART) & (has(text, CHART) | ~has(text, QUESTION))


def intents(messages: DataFrame) -> DataFrame:
    """`messages` (msg_id, text) plus what the wording says: type, top-n, average, sales, time, grain, chart or answer; nulls for a null."""
    t = F.col("folded")
    return messages.withColumn("folded", folded(F.trim("text"))).withColumns({
        "named_type": first_of(t, TYPES), "top": top_n(t), "ranking": has(t, RANKING), "average": has(t, AVERAGE),
        "sales": has(t, SALES), "timely": has(t, TIME), "time_grain": first_of(t, GRAIN), "chart": wants_chart(t),
    })


def small(catalog: DataFrame) -> DataFrame:
    """The catalog for broadcast, in normal form; a table of more than MAX_CATALOG columns is refused."""
    rows = catalog.select("column", "role", "ordinal").limit(MAX_CATALOG + 1).collect()
    if len(rows) > MAX_CATALOG:
        raise ValueError(f"a catalog of more than {MAX_CATALOG} columns")
    made = catalog.sparkSession.createDataFrame([tuple(r) for r in rows], "column string, role string, ordinal int")
    return F.broadcast(made.withColumn("needle", folded(F.col("column"))))


@F.pandas_udf(DoubleType())
def word_ratio(word: pd.Series, needle: pd.Series) -> pd.Series:
    """The sequence ratio of two words; called for different pairs only."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(word, needle)])


def grams(text: Column, n: int) -> Column:
    """The stretches of n letters of a text, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _by_word(words: DataFrame, cat: DataFrame) -> DataFrame:
    """(word, column, role, ordinal, rule) of different words: 1 if inside the name, 2 if a near-spelling of it.

    Either shares two letters in a row with the name: were all matched letters of a near-spelling apart, as many would
    be unmatched, and the ratio under 0.8.
    """
    needle, word = F.col("needle"), F.col("word")
    pairs = cat.select("*", F.explode(F.array_distinct(grams(needle, 2))).alias("key"))
    met = words.withColumn("key", F.explode(F.array_distinct(grams(word, 2)))).join(pairs, "key").select("word", "column", "role", "ordinal", "needle")
    inside, both = needle.contains(word), F.length("word") + F.length("needle")
    alike = (F.length("word") >= 4) & (2 * F.least(F.length("word"), F.length("needle")) >= SIMILAR * both)
    met = met.where(inside | alike).distinct()
    near = met.where(~inside).withColumn("ratio", word_ratio("word", "needle")).where(F.col("ratio") >= SIMILAR)
    return met.where(inside).select("word", "column", "role", "ordinal", F.lit(1).alias("rule")).unionByName(near.select("word", "column", "role", "ordinal", F.lit(2).alias("rule")))


def mentions(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(msg_id, column, role, ordinal, at): columns a message names, and where: whole name, part of a word, near-spelling.

    Columns are met by keys, not by trying all: a name in a text by its first letters, a word inside a name or a
    near-spelling by two letters in a row. The words that mean a column are found once for all messages; up to
    MAX_WORDS of them are broadcast, more are joined.
    """
    cat = small(catalog)
    needle = F.col("needle")
    base = messages.select("msg_id", folded(F.trim(F.coalesce("text", F.lit("")))).alias("t"))
    words = base.select("msg_id", "t", F.posexplode(F.regexp_extract_all("t", F.lit(r"([a-z0-9_]{3,})"), F.lit(1))).alias("k", "word"))
    # The whole name somewhere in the text.
    heads = cat.where(needle != "").select("*", F.left(needle, F.lit(3)).alias("key"))
    sizes = [r[0] for r in heads.select(F.length("key")).distinct().collect()]
    keys = base.select("msg_id", "t", F.explode(F.concat(*[grams(F.col("t"), n) for n in sizes or [3]])).alias("key"))
    whole = keys.join(heads, "key").withColumn("at", F.instr(F.col("t"), needle)).where("at > 0")
    whole = whole.select("msg_id", "column", "role", "ordinal", F.lit(0).alias("rule"), F.lit(0).alias("k"), "at")
    # A word inside the name, or a near-spelling of it.
    by_word = _by_word(words.select("word").distinct(), cat).persist()
    if by_word.count() <= MAX_WORDS:
        met = words.join(F.broadcast(by_word), "word")
    else:
        met = words.drop("t").join(by_word, "word").join(base, "msg_id")
    met = met.select("msg_id", "column", "role", "ordinal", "rule", "k", F.instr(F.col("t"), F.col("word")).alias("at"))
    return whole.unionByName(met).groupBy("msg_id", "column", "role", "ordinal").agg(F.min(F.struct("rule", "k", "at"))["at"].alias("at"))


def synonym_dimensions(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(msg_id, synonym): the first dimension that a business word of the message stands for."""
    t = F.col("t")
    base = messages.select("msg_id", folded(F.trim(F.coalesce("text", F.lit("")))).alias("t"))
    rules = F.array_compact(F.array(*[F.when(has(t, p), F.struct(F.lit(i).alias("rule"), F.lit("|".join(n)).alias("needles"))) for i, (p, n) in enumerate(SYNONYMS)]))
    hits = base.select("msg_id", F.explode(rules).alias("r")).select("msg_id", "r.*").join(small(catalog).where("role = 'dimension'"), F.regexp_like(F.col("needle"), F.col("needles")))
    return hits.groupBy("msg_id").agg(F.min_by("column", F.struct("rule", "ordinal")).alias("synonym"))


def _matched(phrases: DataFrame, catalog: DataFrame, phrase: str, name: str) -> DataFrame:
    """(msg_id, name, name_role): the column a phrase means: equal first, then one inside the other, in column order."""
    p, n = F.col(phrase), F.lower("column")
    fits = phrases.where(p != "").join(small(catalog), (n == p) | n.contains(p) | p.contains(n))
    best = F.min_by(F.struct("column", "role"), F.struct((n != p).alias("inexact"), "ordinal"))
    return fits.groupBy("msg_id").agg(best.alias("best")).select("msg_id", F.col("best.column").alias(name), F.col("best.role").alias(f"{name}_role"))


def strict(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(msg_id, chart_type, dimension, measure, agg, top_n) of messages in the form `[top N] [MEASURE by] DIMENSION as TYPE chart`."""
    text = F.trim(F.coalesce("text", F.lit("")))
    parts = messages.select("msg_id", F.trim(F.regexp_extract(text, STRICT, 1)).alias("body"), F.lower(F.regexp_extract(text, STRICT, 2)).alias("chart_type")).where("chart_type <> ''")
    parts = parts.withColumn("top_n", F.when(F.regexp_extract("body", TOP, 1) != "", F.regexp_extract("body", TOP, 1).try_cast("int"))).withColumn("body", F.lower(F.trim(F.regexp_replace("body", TOP, ""))))
    split = F.split("body", r"\bby\b", 2)
    two = F.size(split) == 2
    parts = parts.where("body <> ''").withColumn("measure_phrase", F.when(two, F.trim(split[0])).otherwise("")).withColumn("dimension_phrase", F.trim(F.when(two, split[1]).otherwise(split[0])))
    out = parts.join(_matched(parts, catalog, "dimension_phrase", "d"), "msg_id").join(_matched(parts, catalog, "measure_phrase", "m"), "msg_id", "left").where("measure_phrase = '' or m is not null")
    swap = F.coalesce((F.col("m_role") == "dimension") & (F.col("d_role") == "measure"), F.lit(False))
    return out.select("msg_id", "chart_type", F.when(swap, F.col("m")).otherwise(F.col("d")).alias("dimension"), F.when(swap, F.col("d")).otherwise(F.col("m")).alias("measure"), F.when(F.col("m").isNull(), "count").otherwise("sum").alias("agg"), "top_n")


def _main_measure(catalog: DataFrame) -> Column:
    rows = sorted(catalog.where("role = 'measure'").select("column", "ordinal").collect(), key=lambda r: r["ordinal"])
    names = [r["column"] for r in rows]
    main = next((n for w in PRIORITY for n in names if w in n.lower()), names[0] if names else None)
    return F.lit(main).cast("string")


def resolve(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a message: msg_id, resolved (chart, answer, scalar or none), chart_type, dimension, measure, agg, top_n, grain.

    In this order: the strict form; a named dimension; a business word; the date column when named or meant; the only
    dimension on a ranking; a single figure when a question names a measure; else none. Blank messages resolve to none.
    """
    tagged = intents(messages.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("blank", F.col("folded") == "").drop("text", "folded")
    cat = [tuple(r) for r in catalog.select("column", "role", "ordinal").collect()]
    dates, dims = ([c for c, role, _ in sorted(cat, key=lambda x: x[2]) if role == r] for r in ("date", "dimension"))
    date, only, main = F.lit(dates[0] if dates else None).cast("string"), F.lit(dims[0] if len(dims) == 1 else None).cast("string"), _main_measure(catalog)
    named = mentions(messages, catalog)
    place = F.struct("at", "ordinal")
    pick = lambda role: F.min_by(F.when(F.col("role") == role, F.col("column")), F.when(F.col("role") == role, place))
    measures = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "measure", F.struct("at", "ordinal", "column")))), lambda x: x["column"])
    named = named.groupBy("msg_id").agg(pick("dimension").alias("named_dimension"), measures.alias("named_measures"), F.max(F.col("role") == "date").alias("named_date"))
    rows = tagged.join(named, "msg_id", "left").join(synonym_dimensions(messages, catalog), "msg_id", "left")
    rows = rows.join(strict(messages, catalog).select("msg_id", *[F.col(c).alias(f"s_{c}") for c in ("chart_type", "dimension", "measure", "agg", "top_n")]), "msg_id", "left")
    on_date = F.when(F.coalesce("named_date", F.lit(False)) | F.col("timely"), date)
    loose = F.coalesce("named_dimension", "synonym", on_date, F.when(F.col("ranking"), only))
    axis = F.coalesce(F.col("dimension") == date, F.lit(False))
    said = F.get(F.filter("named_measures", lambda m: ~m.eqNullSafe(F.col("dimension"))), F.lit(0))
    rows = rows.withColumn("dimension", loose).withColumn("axis", axis)
    rows = rows.withColumn("measure", F.coalesce(said, F.when(F.col("sales") | F.col("ranking") | F.col("axis"), main)))
    scalar = F.coalesce(F.get("named_measures", F.lit(0)), F.when(F.col("sales"), main))
    is_strict, found, alone = F.col("s_dimension").isNotNull(), F.col("dimension").isNotNull(), ~F.col("chart") & scalar.isNotNull()
    blank = F.col("blank")
    kind = F.when(blank, "none").when(is_strict | found, F.when(F.col("chart"), "chart").otherwise("answer")).when(alone, "scalar").otherwise("none")
    agg = lambda m: F.when(m.isNull(), "count").when(F.col("average"), "mean").otherwise("sum")
    by = lambda strictly, loosely, single=None: F.when(blank, None).when(is_strict, strictly).when(found, loosely).when(alone, single)
    none = F.lit(None)
    return rows.select(
        "msg_id", kind.alias("resolved"),
        by(F.col("s_chart_type"), F.when(F.col("axis") & F.col("named_type").isNull(), "line").otherwise(F.coalesce("named_type", F.lit("bar"))), none).alias("chart_type"),
        by(F.col("s_dimension"), F.col("dimension"), none).alias("dimension"), by(F.col("s_measure"), F.col("measure"), scalar).alias("measure"),
        by(F.col("s_agg"), agg(F.col("measure")), agg(scalar)).alias("agg"), by(F.col("s_top_n"), F.when(~F.col("axis"), F.col("top")), none).alias("top_n"),
        by(none, F.when(F.col("axis"), F.col("time_grain")), none).alias("grain"),
    )


def validate_json(proposals: DataFrame, catalog: DataFrame) -> DataFrame:
    """(msg_id, accepted, chart_type, dimension, measure, agg, top_n, grain) of requests held as JSON text.

    The outermost braces are cut out and parsed. An unknown dimension rejects; an unknown measure becomes a count; a
    bad type is bar, a bad aggregate sum or count, a top_n outside 1 to 50 none; a grain stays on the date column only.
    """
    cat = small(catalog).select("column", "role")
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    shape = "dimension string, measure string, chart_type string, agg string, top_n string, grain string"
    j = proposals.select("msg_id", F.from_json(body, shape).alias("j"), F.get_json_object(body, "$.top_n").alias("top")).select("msg_id", "j.*", "top").drop("top_n")
    j = j.join(cat.select(F.col("column").alias("dimension"), F.col("role").alias("d_role")), "dimension", "left").join(cat.select(F.col("column").alias("measure"), F.lit(True).alias("m_known")), "measure", "left")
    ok = F.col("d_role").isNotNull()
    measure = F.when(F.col("m_known"), F.col("measure"))
    agg = F.when(measure.isNull(), "count").when(F.col("agg").isin("sum", "count", "mean"), F.col("agg")).otherwise("sum")
    top = F.when(F.col("top").rlike(r"^\d{1,2}$") & F.col("top").try_cast("int").between(1, 50), F.col("top").try_cast("int"))
    grain = F.when(F.col("grain").isin(*GRAINS) & (F.col("d_role") == "date"), F.col("grain"))
    kind = F.when(F.col("chart_type").isin("bar", "line", "pie"), F.col("chart_type")).otherwise("bar")
    return j.select("msg_id", ok.alias("accepted"), *[F.when(ok, x).alias(n) for n, x in (("chart_type", kind), ("dimension", F.col("dimension")), ("measure", measure), ("agg", agg), ("top_n", top), ("grain", grain))])


def confirmation(requests: DataFrame) -> DataFrame:
    """`requests` plus `confirmation`: what is charted, in words; null where nothing is."""
    label = F.when(F.col("agg") == "sum", "total").when(F.col("agg") == "mean", "average").otherwise("count of")
    what = F.when(F.col("measure").isNull(), "row count").otherwise(F.concat(label, F.lit(" **"), F.col("measure"), F.lit("**")))
    scope = F.coalesce(F.concat(F.lit("top "), F.col("top_n").cast("string"), F.lit(" ")), F.lit(""))
    per = F.coalesce(F.concat(F.lit(" per "), F.col("grain")), F.lit(""))
    return requests.withColumn("confirmation", F.concat(F.lit("Added: "), what, F.lit(" by "), scope, F.lit("**"), F.col("dimension"), F.lit("**"), per, F.lit(", as a **"), F.col("chart_type"), F.lit("** chart.")))


def answers(df: DataFrame, requests: DataFrame) -> DataFrame:
    """(msg_id, x, value): the data of every resolved chart, as `chart_query` gives them.

    All requests share one read of the table, however many messages ask them on however many axes, grains and measures;
    their top-n and type only choose rows of it. What is collected is the different (dimension, grain, measure, aggregate).
    """
    keys = ["dimension", "grain", "measure", "agg"]
    asked = requests.where("dimension is not null")
    wanted = sorted((tuple(r) for r in asked.select(*keys).distinct().collect()), key=str)
    if not wanted:
        return requests.select("msg_id", F.lit("").alias("x"), F.lit(0.0).alias("value")).where("false")
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("value"), F.asc("number"), F.asc("x")))
    rows = grouped_many(df, wanted).withColumn("place", place)
    known = [(k, *w, type_class(df.schema[w[0]].dataType) == DATE) for k, w in enumerate(wanted)]
    known = df.sparkSession.createDataFrame(known, "k int, " + ", ".join(f"k_{c} string" for c in keys) + ", dated boolean")
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys]
    asked = asked.join(F.broadcast(known), same)  # a row a different request
    along_x = F.col("dated") | ((F.col("chart_type") == "line") & F.col("measure").isNotNull() & (F.col("agg") != "count"))
    return asked.join(rows, "k").where(along_x | F.col("top_n").isNull() | (F.col("place") <= F.col("top_n"))).select("msg_id", "x", "value")
