"""The column profile: one row for each column of a table, and what is read off it.

Two aggregates over the table: one pass for nulls, sizes, pattern hits and sketches, one for exact distinct counts. The
latter turns cells into rows (column, value), grouped with partial sums, so that its plan does not widen with the
table; `distinct="screened"` counts exactly only where a sketch is near a threshold of the rules. Tables of more than
`BATCH` columns are read in batches of columns, each column once. Everything else is an expression over the profile,
which has as many rows as the table has columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import BOOL, DATE, NUMERIC, OTHER, TEXT, named, to_moment, type_class, value_of
from tidemark.operators.quantiles import quantiles

#: What marks personal data in a column's name and in its values.
PII_WORDS = ("email", "mail", "phone", "tel", "ssn", "dni", "passport", "name", "nombre", "address", "direccion", "birth", "dob", "card")
EMAIL = r"(?U)[^@\s]+@[^@\s]+\.[^@\s]+"
PHONE = r"(?U)\+?\d[\d\s\-()]{7,}\d"
PLAIN_NUMBER = r"(?U)^\s*-?\d+(\.\d+)?\s*\z"
#: Upper lengths of the text buckets.
TEXT_BUCKETS = (50, 100, 255, 500, 1000, 4000)
INT_LIMIT = 2147483647
PATTERNS = ("pii_hits", "date_hits", "number_hits")
BATCH = 40  # columns of one pass
PII_SAMPLE, DATE_SAMPLE, NUMBER_SAMPLE = 20, 50, 30


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(F.lit(100.0) * part, whole), 1), F.lit(0.0))


def id_like_loose(name: Column) -> Column:
    """The rule for keys: the name ends in `id`."""
    return F.lower(name).endswith("id")


def pii_name(name: str) -> bool:
    return any(w in name.lower() for w in PII_WORDS)


def personal(c: Column) -> Column:
    """Whether a text has an e-mail address or a phone number; each pattern runs only where its mark occurs."""
    return (c.contains("@") & c.rlike(EMAIL)) | (c.rlike("(?U)\\d") & c.rlike(PHONE))


def measures(field: T.StructField, patterns: bool) -> dict[str, Column]:
    """The profile's aggregates of a column."""
    c, kind = value_of(field), type_class(field.dataType)
    null = F.lit(None)
    size = F.max(F.length(c)) if kind == TEXT else null
    largest = F.max(F.abs(named(field.name).cast("decimal(38,0)"))) if isinstance(field.dataType, T.IntegralType) else null
    hits = [null] * 3
    if kind == TEXT and patterns:
        hits = [null if pii_name(field.name) else F.count_if(personal(c)), F.count_if(to_moment(c).isNotNull()), F.count_if(c.rlike(PLAIN_NUMBER))]
    return {"n_rows": F.count(F.lit(1)), "nulls": F.count_if(c.isNull()), "max_len": size.cast("long"), "max_abs": largest.cast("decimal(38,0)"), **{n: h.cast("long") for n, h in zip(PATTERNS, hits)}}


def column_rows(df: DataFrame, cells: list[dict[str, Column]]) -> DataFrame:
    """One row a column: ordinal, column, dtype, class, name_pii, is_int, and its aggregates under their names."""
    fields, out = df.schema.fields, None
    for start in range(0, len(fields) or 1, BATCH):
        part = list(enumerate(fields))[start : start + BATCH]
        if part:
            row = df.agg(*[x.alias(f"{n}_{i}") for i, _ in part for n, x in cells[i].items()])
        else:
            row = df.agg(F.count(F.lit(1)).alias("n")).where("false")
        cell = lambda i, f: F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(type_class(f.dataType)).alias("class"),
            F.lit(pii_name(f.name)).alias("name_pii"), F.lit(isinstance(f.dataType, T.IntegralType)).alias("is_int"), *[F.col(f"{n}_{i}").alias(n) for n in cells[i]],
        )
        none = {"ordinal": "int", "column": "string", "dtype": "string", "class": "string", "name_pii": "boolean", "is_int": "boolean", **dict.fromkeys(("n_rows", "nulls", "max_len", *PATTERNS), "long"), "max_abs": "decimal(38,0)"}
        rows = row.select(F.explode(F.array(*[cell(i, f) for i, f in part])).alias("x")).select("x.*") if part else row.select(*[F.lit(None).cast(t).alias(n) for n, t in none.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def _sampled(df: DataFrame, texts: list[str], order: str) -> DataFrame:
    """(column, n20, pii20, n50, date50, n30, num30) over the first values of each text column in the given order."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).alias("v")) for c in texts]))
    rows = df.select(named(order).alias("key"), cells.alias("x")).select("key", "x.*").where("v is not null")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("key", "v"))).where(F.col("k") <= DATE_SAMPLE)
    v, within = F.col("v"), lambda n: F.col("k") <= n
    return first.groupBy("column").agg(
        F.count_if(within(PII_SAMPLE)).alias("pii_n"), F.count_if(within(PII_SAMPLE) & personal(v)).alias("pii_hits"),
        F.count("*").alias("date_n"), F.count_if(to_moment(v).isNotNull()).alias("date_hits"),
        F.count_if(within(NUMBER_SAMPLE)).alias("number_n"), F.count_if(within(NUMBER_SAMPLE) & v.rlike(PLAIN_NUMBER)).alias("number_hits"),
    )


def _countable(field: T.StructField, hashed: bool) -> Column:
    """The value as a grouping key: long texts by two 64-bit hashes, so that no shuffle carries them."""
    c, kind = value_of(field), type_class(field.dataType)
    if kind == TEXT:
        return F.when(F.octet_length(c) > 32, F.concat(F.hex(F.xxhash64(c)), F.lit("/"), F.hex(F.xxhash64(F.lit(1), c)))).otherwise(c) if hashed else c
    if kind == BOOL or isinstance(field.dataType, T.IntegralType):
        return c.cast("long")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    return c.cast("string") if kind in (NUMERIC, DATE) else c  # one text for each value of a type


def distinct_counts(df: DataFrame, ordinals: list[int], hashed: bool = True) -> DataFrame:
    """(ordinal, n_distinct) of the given columns, exactly: cells become rows (column, value) of one type at a time.

    Without `hashed` texts of any length are grouped by themselves.
    """
    fields, kinds = df.schema.fields, {}
    for i in ordinals:
        f = fields[i]
        kind = type_class(f.dataType)
        key = f.dataType.simpleString() if kind == OTHER else "long" if kind == BOOL or isinstance(f.dataType, T.IntegralType) else "double" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else "string"
        kinds.setdefault(key, []).append(i)
    out = df.sparkSession.createDataFrame([(i,) for i in ordinals], "ordinal int")
    counts = None
    for group in kinds.values():
        for start in range(0, len(group), BATCH):
            cells = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), _countable(fields[i], hashed).alias("v")) for i in group[start : start + BATCH]]))
            values = df.select(cells.alias("x")).select("x.*").where("v is not null").groupBy("ordinal", "v").agg(F.lit(1).alias("one"))
            part = values.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_distinct"))
            counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return out.withColumn("n_distinct", F.lit(None).cast("long"))
    return out.join(F.broadcast(counts), "ordinal", "left").select("ordinal", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))  # a row a column


def estimated_distinct(c: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(12)))


def near_threshold(row, share: float = 0.12) -> bool:
    """Whether a sketch's estimate leaves open what a rule on distinct counts says.

    The rules look at 1, 2, 8, 30 and 50 values, a fifth of the values seen, and all rows of a column without nulls.
    The sketch errs by 1.6 % in the root mean square, so `share` is seven times its error.
    """
    estimate, seen = row["n_distinct"], row["n_rows"] - row["nulls"]
    return estimate <= 50 * (1 + share) + 4 or abs(estimate - 0.2 * seen) <= share * 0.2 * seen or (row["nulls"] == 0 and estimate >= (1 - share) * seen)


def profile(df: DataFrame, distinct: str = "exact", sample_order: str | None = None, hash_texts: bool = True) -> DataFrame:
    """One row a column: ordinal, column, dtype, class, n_rows, nulls, null_pct, n_distinct, is_pk_candidate, sql_type,
    is_pii, date_like, number_like, number_seen.

    Patterns look at all values, or with `sample_order` at the first 20, 50 and 30 in that column's order. Distinct
    counts are exact, `screened` (exact where a rule may depend on them, else estimates: the same keys and roles) or
    `approx`. `hash_texts` tells long texts apart by two hashes. Nested and binary columns report nulls; maps have no distinct count.
    """
    if distinct not in ("exact", "screened", "approx"):
        raise ValueError(f"unknown way to count {distinct!r}")
    fields = df.schema.fields
    texts = [f.name for f in fields if type_class(f.dataType) == TEXT]
    countable = [i for i, f in enumerate(fields) if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    cells = [measures(f, sample_order is None) for f in fields]
    if distinct != "exact":
        for i, f in enumerate(fields):
            cells[i]["n_distinct"] = estimated_distinct(value_of(f)) if i in countable else F.lit(None).cast("long")
    cells = column_rows(df, cells)
    if distinct == "exact":
        cells = cells.join(F.broadcast(distinct_counts(df, countable, hash_texts)), "ordinal", "left")  # a row a column
    elif distinct == "screened":
        rows = cells.collect()
        cells = df.sparkSession.createDataFrame(rows, cells.schema)
        open_ = [r["ordinal"] for r in rows if r["n_distinct"] is not None and near_threshold(r)]
        exact = distinct_counts(df, open_, hash_texts).withColumnRenamed("n_distinct", "exact")
        cells = cells.join(F.broadcast(exact), "ordinal", "left").withColumn("n_distinct", F.coalesce("exact", "n_distinct")).drop("exact")
    if sample_order is not None and texts:
        cells = cells.drop(*PATTERNS).join(F.broadcast(_sampled(df, texts, sample_order)), "column", "left")
    return read_off(cells)


def read_off(cells: DataFrame) -> DataFrame:
    """The profile by the aggregates of each column. Patterns are shares of all values, unless the rows say of how many."""
    seen = F.col("n_rows") - F.col("nulls")
    cells = cells.withColumns({f"{what}_n": seen for what in ("pii", "date", "number") if f"{what}_n" not in cells.columns})
    is_text = F.col("class") == TEXT
    share = lambda what: is_text & (F.col(f"{what}_n") > 0) & (F.col(f"{what}_hits") >= 0.8 * F.col(f"{what}_n"))
    date_like = F.coalesce(share("date"), F.lit(False))
    by_value = is_text & ~date_like & (F.col("pii_n") > 0) & (F.col("pii_hits") >= F.greatest(F.lit(3), F.floor(F.col("pii_n") / 2)))
    text_type = reduce(lambda rest, n: F.when(F.coalesce("max_len", F.lit(0)) <= n, f"NVARCHAR({n})").otherwise(rest), reversed(TEXT_BUCKETS), F.lit("NVARCHAR(MAX)"))
    sql_type = (
        F.when(F.col("class") == BOOL, "BIT").when(F.col("class") == DATE, "DATETIME2")
        .when(F.col("is_int"), F.when(F.coalesce("max_abs", F.lit(0)) < INT_LIMIT, "INT").otherwise("BIGINT"))
        .when(F.col("dtype").startswith("decimal"), F.upper("dtype")).when(F.col("class") == NUMERIC, "DECIMAL(18,2)")
        .when(F.col("class") == OTHER, "NVARCHAR(MAX)").otherwise(text_type)
    )
    return cells.select(
        "ordinal", "column", "dtype", "class", "n_rows", "nulls", pct(F.col("nulls"), F.col("n_rows")).alias("null_pct"), "n_distinct",
        F.coalesce((F.col("nulls") == 0) & (F.col("n_distinct") == F.col("n_rows")) & (F.col("n_rows") > 0), F.lit(False)).alias("is_pk_candidate"),
        sql_type.alias("sql_type"), (F.col("name_pii") | F.coalesce(by_value, F.lit(False))).alias("is_pii"), date_like.alias("date_like"),
        F.coalesce(share("number"), F.lit(False)).alias("number_like"), F.coalesce("number_hits", F.lit(0)).alias("number_seen"),
        F.col("is_int"),
    )


def personal_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The rows with an e-mail address or a phone number in one of the columns."""
    return df.where(reduce(Column.__or__, [personal(named(c)) for c in columns]))


def overview(df: DataFrame) -> DataFrame:
    kinds = len({f.dataType.simpleString() for f in df.schema.fields})
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(kinds).cast("long").alias("n_dtypes"))


def schema_list(df: DataFrame) -> DataFrame:
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string")


def nulls_by_column(prof: DataFrame) -> DataFrame:
    return prof.where("nulls > 0").select("column", "nulls", "null_pct")


def shown_profile(prof: DataFrame) -> DataFrame:
    return prof.select("column", "dtype", F.col("n_distinct").alias("unique"), F.col("nulls").alias("missing"))


def column_facts(df: DataFrame, column: str, order: str, n: int = 5) -> DataFrame:
    """(dtype, n_distinct, nulls, first_values): the first n different values by where they first occur."""
    f = df.schema[column]
    c = value_of(f)
    base = df.agg(F.count_distinct(c).alias("n_distinct"), F.count_if(c.isNull()).alias("nulls"))
    firsts = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.min(named(order)).alias("at")).orderBy("at", "v").limit(n)
    firsts = firsts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.col("v").cast("string").alias("v")))), lambda x: x["v"]), ", ").alias("first_values"))
    return base.crossJoin(F.broadcast(firsts)).select(F.lit(f.dataType.simpleString()).alias("dtype"), "*")


def numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) of each numeric column; quartiles interpolate.

    Exact quartiles are selected by rank in a few passes (`quantiles.py`); without `exact` a sketch of bounded size
    gives values of the table within a ten-thousandth of its ranks, in the one pass.
    """
    fields = [f for f in df.schema.fields if type_class(f.dataType) == NUMERIC]
    share = (0.25, 0.5, 0.75)
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    parts = lambda c: [F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c), *([] if exact else [F.percentile_approx(c, F.array(*map(F.lit, share)), 10_000)])]
    names = ("count", "mean", "std", "min", "max", *(() if exact else ("quantiles",)))
    kinds = {"count": "long", "quantiles": "array<double>"}
    row = df.agg(*[x.cast(kinds.get(n, "double")).alias(f"{n}_{i}") for i, f in enumerate(fields) for n, x in zip(names, parts(value_of(f).cast("double")))])
    if exact:
        row = df.sparkSession.createDataFrame(row.collect(), row.schema)  # one row; its counts and extremes begin the selection
        found = row.first()
        extent = {f.name: (found[f"count_{i}"], found[f"min_{i}"], found[f"max_{i}"]) for i, f in enumerate(fields)}
    cells = [F.struct(F.lit(f.name).alias("column"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, f in enumerate(fields)]
    rows = row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    if exact:
        rows = rows.join(F.broadcast(quantiles(df, list(extent), share, extent)), "column")  # a row a column
    return rows.select("column", "count", "mean", "std", "min", *[F.get("quantiles", F.lit(i)).alias(p) for i, p in enumerate(("p25", "p50", "p75"))], "max")
