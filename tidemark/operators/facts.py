"""Headline figures behind a chart: totals, spans, leaders, and the sentences that state them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_money, number_text
from tidemark.functions.types import DATE, named, type_class, value_of
from tidemark.operators.charts import ChartRequest, grouped, mean, measure_of


def scalar_facts(df: DataFrame, measure: str) -> DataFrame:
    """(total, mean, n_values, n_rows) of a measure, no grouping."""
    y = measure_of(df, measure)
    return df.agg(F.sum(y).alias("total"), mean(y).alias("mean"), F.count(y).alias("n_values"), F.count("*").alias("n_rows"))


def scalar_answer(df: DataFrame, measure: str, agg: str = "sum") -> DataFrame:
    facts, money = scalar_facts(df, measure), is_money(measure)
    if agg == "mean":
        said = F.concat(F.lit(f"Average {measure} is "), number_text(F.col("mean"), money), F.lit("."))
    else:
        said = F.concat(F.lit(f"Total {measure} is "), number_text(F.col("total").cast("double"), money), F.lit(" across "), F.format_number("n_rows", 0), F.lit(" rows."))
    return facts.select(F.when(F.col("n_values") == 0, f"No numeric values found in {measure}.").otherwise(said).alias("answer"))


def leader(groups: DataFrame) -> DataFrame:
    """The one row of largest value; of equal ones the smallest x; none if all are missing."""
    return groups.where("value is not null").orderBy(F.desc("value"), F.asc("x")).limit(1)


def count_facts(df: DataFrame, dimension: str) -> DataFrame:
    """(n_rows, n_groups, leader, leader_value)."""
    x = value_of(df.schema[dimension])
    rows = df.agg(F.count("*").alias("n_rows"), F.count_distinct(x).alias("n_groups"))
    top = leader(grouped(df, ChartRequest(dimension))).select(F.col("x").cast("string").alias("leader"), F.col("value").alias("leader_value"))
    return rows.join(F.broadcast(top), how="left")


def time_facts(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """(total, mean, n_values, first_date, last_date)."""
    y = measure_of(df, measure)
    return df.agg(F.sum(y).alias("total"), mean(y).alias("mean"), F.count(y).alias("n_values"), F.min(named(dimension)).cast("date").alias("first_date"), F.max(named(dimension)).cast("date").alias("last_date"))


def group_facts(df: DataFrame, dimension: str, measure: str, agg: str = "sum") -> DataFrame:
    """(total, mean, n_values, leader, leader_value, leader_share); the share is of the total over all rows."""
    top = leader(_valued_groups(df, dimension, measure, agg)).select(F.col("x").cast("string").alias("leader"), F.col("value").alias("leader_value"))
    out = scalar_facts(df, measure).join(F.broadcast(top), how="left")
    share = F.when(F.lit(agg == "sum"), F.try_divide(F.col("leader_value").cast("double"), F.col("total").cast("double")))
    return out.drop("n_rows").withColumn("leader_share", share)


def _valued_groups(df, dimension, measure, agg):
    return grouped(df, ChartRequest(dimension, measure, agg))


def answer(df: DataFrame, request: ChartRequest) -> DataFrame:
    """One row `answer`: the figures of a request in words."""
    dimension, measure = request.dimension, request.measure
    if measure is None:
        f = count_facts(df, dimension)
        most = F.concat(F.lit(" across "), F.col("n_groups").cast("string"), F.lit(f" {dimension} values; most common is **"), F.col("leader"), F.lit("** with "), number_text(F.col("leader_value")), F.lit("."))
        return f.select(F.concat(number_text(F.col("n_rows")), F.lit(" rows"), F.coalesce(most, F.lit("."))).alias("answer"))
    money = is_money(measure)
    none = F.when(F.col("n_values") == 0, f"No numeric values found in {measure}.")
    word, figure = ("Average", F.col("mean")) if request.agg == "mean" else ("Total", F.col("total").cast("double"))
    start = F.concat(F.lit(f"{word} {measure} is "), number_text(figure, money))
    if type_class(df.schema[dimension].dataType) == DATE:
        f = time_facts(df, dimension, measure)
        span = F.concat(F.lit(" between "), F.col("first_date").cast("string"), F.lit(" and "), F.col("last_date").cast("string"))
        return f.select(none.otherwise(F.concat(start, F.coalesce(span, F.lit("")), F.lit("."))).alias("answer"))
    f = group_facts(df, dimension, measure, "mean" if request.agg == "mean" else "sum")
    best = number_text(F.col("leader_value").cast("double"), money)
    if request.agg == "mean":
        rest = F.concat(F.lit(f" overall; highest for {dimension} **"), F.col("leader"), F.lit("** at "), best, F.lit("."))
    else:
        share = F.coalesce(F.format_string(" (%.0f%% of the total)", F.col("leader_share") * 100), F.lit(""))
        rest = F.concat(F.lit(f"; {dimension} **"), F.col("leader"), F.lit("** leads with "), best, F.when(F.col("total") != 0, share).otherwise(""), F.lit("."))
    return f.select(none.otherwise(F.concat(start, F.coalesce(rest, F.lit(".")))).alias("answer"))
