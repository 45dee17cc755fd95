"""The chart query: one grouped aggregate with optional time bucket, order and top-n."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.types import DATE, NUMERIC, named, to_number, type_class, value_of

MAX_SETS = 32  # grouping sets of one read
GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class ChartRequest:
    dimension: str
    measure: str | None = None
    agg: str = "sum"
    chart_type: str = "bar"
    top_n: int | None = None
    grain: str | None = None
    title: str = ""


def bucketed(df: DataFrame, column: str, grain: str | None) -> DataFrame:
    """Dates cut to the grain (weeks begin on Monday); unchanged without a grain or on other columns."""
    if grain not in GRAINS or type_class(df.schema[column].dataType) != DATE:
        return df
    return df.withColumn(column, F.date_trunc(grain, named(column)).cast("timestamp_ntz"))


def measure_of(df: DataFrame, measure: str):
    """The measure as a number: NaN is missing, text that is no number too, a boolean counts 1 or 0."""
    kind = df.schema[measure].dataType
    if type_class(kind) == NUMERIC:
        return value_of(df.schema[measure])
    return named(measure).cast("int") if kind.typeName() == "boolean" else to_number(named(measure).cast("string"))


def mean(y):
    return F.try_divide(F.sum(y).cast("double"), F.count(y))


def aggregate_of(df: DataFrame, measure: str | None, agg: str):
    if measure is None or agg == "count":
        return F.count("*")
    if agg == "mean":
        return mean(measure_of(df, measure))
    if agg == "sum":
        return F.coalesce(F.sum(measure_of(df, measure)), F.lit(0))
    raise ValueError(f"unknown aggregate {agg!r}")


def grouped_values(df: DataFrame, dimension: str, grain: str | None, values: list[tuple[str | None, str]]) -> DataFrame:
    """(x, v0, v1, ...): several (measure, aggregate) of all categories in one pass, missing categories left out."""
    df = bucketed(df, dimension, grain)
    rows = df.where(value_of(df.schema[dimension]).isNotNull())
    return rows.groupBy(named(dimension).alias("x")).agg(*[aggregate_of(df, m, a).alias(f"v{i}") for i, (m, a) in enumerate(values)])


def grouped(df: DataFrame, request: ChartRequest) -> DataFrame:
    """(x, value) of all categories, missing ones left out."""
    return grouped_values(df, request.dimension, request.grain, [(request.measure, request.agg)]).withColumnRenamed("v0", "value")


def along_x(df: DataFrame, request: ChartRequest) -> bool:
    """Whether a chart runs along its x: dates do, and lines of a measure."""
    counts = request.measure is None or request.agg == "count"
    return type_class(df.schema[request.dimension].dataType) == DATE or (request.chart_type == "line" and not counts)


def top_limit(df: DataFrame, request: ChartRequest) -> int | None:
    return None if along_x(df, request) else request.top_n


def chart_query(df: DataFrame, request: ChartRequest, axis_as_text: bool = False) -> DataFrame:
    """(x, value): by x on a date axis and for lines, else by value downward, then x; top_n only there."""
    out = grouped(df, request)
    if along_x(df, request):
        out = out.orderBy("x")
    else:
        out = out.orderBy(F.desc("value"), F.asc("x"))
        if request.top_n:
            out = out.limit(request.top_n)
    if axis_as_text and type_class(df.schema[request.dimension].dataType) == NUMERIC:
        out = out.withColumn("x", F.col("x").cast("string"))
    return out


def shares(df: DataFrame, request: ChartRequest) -> DataFrame:
    """(x, value, share): each category's part of the sum over all shown ones, which one row of totals holds."""
    out = grouped(df, request)
    total = out.agg(F.sum("value").cast("double").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("x", "value", F.try_divide(F.col("value").cast("double"), "total").alias("share"))


def grouped_many(df: DataFrame, wanted: list[tuple[str, str | None, str | None, str]]) -> DataFrame:
    """(k, x, number, value) of many (dimension, grain, measure, aggregate) in one read of the table: k is the place in `wanted`.

    Each (dimension, grain) is a grouping set; all sets carry the same aggregates, of which a set's own are taken. `x` is
    text; `number` orders the categories that are no text. Missing categories are left out.
    """
    axes = list(dict.fromkeys((d, g) for d, g, _, _ in wanted))
    if len(axes) > MAX_SETS:  # a read for each so many axes
        first = set(axes[:MAX_SETS])
        parts = [[k for k, w in enumerate(wanted) if (w[:2] in first) == inside] for inside in (True, False)]
        place = lambda ks: F.element_at(F.array(*map(F.lit, ks)), F.col("k") + 1)
        one, two = (grouped_many(df, [wanted[k] for k in ks]).withColumn("k", place(ks)) for ks in parts)
        return one.unionByName(two)
    values = list(dict.fromkeys((None, "count") if m is None or a == "count" else (m, a) for _, _, m, a in wanted))
    axis = [F.date_trunc(g, named(d)).cast("timestamp_ntz") if g in GRAINS and type_class(df.schema[d].dataType) == DATE else value_of(df.schema[d]) for d, g in axes]
    measures = list(dict.fromkeys(m for m, _ in values if m is not None))
    rows = df.select(*[c.alias(f"a{i}") for i, c in enumerate(axis)], *[measure_of(df, m).alias(f"m{i}") for i, m in enumerate(measures)])

    def aggregate(m, a):
        if m is None:
            return F.count("*")
        y = F.col(f"m{measures.index(m)}")
        return mean(y) if a == "mean" else F.coalesce(F.sum(y), F.lit(0))

    names = [f"a{i}" for i in range(len(axes))]
    sets = rows.groupingSets([[F.col(n)] for n in names], *map(F.col, names)).agg(F.grouping_id().alias("set"), *[aggregate(m, a).cast("double").alias(f"v{i}") for i, (m, a) in enumerate(values)])
    out = []
    for i, (dimension, grain) in enumerate(axes):
        own = [(k, values.index((None, "count") if m is None or a == "count" else (m, a))) for k, (d, g, m, a) in enumerate(wanted) if (d, g) == (dimension, grain)]
        kind = type_class(df.schema[dimension].dataType)
        x = F.col(f"a{i}")
        number = x.cast("double") if kind == NUMERIC else F.unix_micros(x.cast("timestamp")).cast("double") if kind == DATE else F.lit(None).cast("double")
        cells = F.array(*[F.struct(F.lit(k).alias("k"), x.cast("string").alias("x"), number.alias("number"), F.col(f"v{v}").alias("value")) for k, v in own])
        out.append(F.when((F.col("set") == (2 ** len(axes) - 1) - 2 ** (len(axes) - 1 - i)) & x.isNotNull(), cells))
    return sets.select(F.explode(F.coalesce(*out)).alias("c")).select("c.*")


def charts(df: DataFrame, requests: list[ChartRequest]) -> DataFrame:
    """(request, place, x, value): what `chart_query` gives for each request, by its place in the list, from one read of the table."""
    if not requests:
        return df.sparkSession.createDataFrame([], "request int, place int, x string, value double")
    rows = grouped_many(df, [(r.dimension, r.grain, r.measure, r.agg) for r in requests])
    shown = df.sparkSession.createDataFrame([(i, along_x(df, r), top_limit(df, r)) for i, r in enumerate(requests)], "request int, along boolean, top int")
    rows = rows.join(F.broadcast(shown), F.col("k") == F.col("request"))  # a row a request
    by_x = [F.when(F.col("along"), F.col(c)) for c in ("number", "x")]
    order = Window.partitionBy("request").orderBy(*by_x, F.desc("value"), F.asc("number"), F.asc("x"))
    return rows.withColumn("place", F.row_number().over(order)).where("top is null or place <= top").select("request", "place", "x", "value")


def histogram(df: DataFrame, measure: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal bins from the least to the largest value; a single value is one bin."""
    rows = df.select(measure_of(df, measure).cast("double").alias("y")).where("y is not null")
    limits = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.width_bucket("y", F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins)))
    counts = rows.crossJoin(F.broadcast(limits)).groupBy(place.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), "n")
