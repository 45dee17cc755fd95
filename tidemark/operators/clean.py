"""Cleaning steps: each takes a DataFrame and returns one; none triggers a job except where a threshold is measured."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.types import TEXT, columns_of, named, numeric_columns, strip_symbols, to_moment, to_number, value_of

MIN_SUCCESS = 0.8


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Without rows whose every cell is missing."""
    return df.na.drop(how="all")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def parse_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns as timestamps, bad values null; by default all whose name contains `date`."""
    if columns is None:
        columns = [c for c in columns_of(df, TEXT) if "date" in c.lower()]
    return df.withColumns({c: to_moment(named(c)) for c in columns if c in columns_of(df, TEXT)})


def lost_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, lost): how many texts parsing would turn into null."""
    if columns is None:
        columns = [c for c in columns_of(df, TEXT) if "date" in c.lower()]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, lost long")
    row = df.agg(*[F.count_if(named(c).isNotNull() & to_moment(named(c)).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("lost")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def fill_numbers(df: DataFrame, value: float = 0) -> DataFrame:
    return df.na.fill(value, subset=numeric_columns(df))


def parse_shares(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, int]]:
    """Share and number of rows whose text is a number once symbols are gone; one pass for all columns."""
    if not columns:
        return {}
    ok = [to_number(strip_symbols(named(c))).isNotNull() for c in columns]
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(x).alias(f"c{i}") for i, x in enumerate(ok)]).first()
    return {c: (row[f"c{i}"] / row["rows"] if row["rows"] else 0.0, row[f"c{i}"]) for i, c in enumerate(columns)}


def coerce_numbers(df: DataFrame, min_success: float | str = MIN_SUCCESS, else_text: bool = False) -> DataFrame:
    """Text columns become doubles where at least `min_success` of all rows parse ("any": one row does).

    With `else_text` other text columns, and columns of nested or binary types, are cast to text, as for export.
    """
    texts = columns_of(df, TEXT)
    shares = parse_shares(df, texts)
    changed: dict[str, Column] = {}
    for c in texts:
        share, n = shares[c]
        if n and (min_success == "any" or share >= min_success):
            changed[c] = to_number(strip_symbols(named(c)))
    if else_text:
        changed |= {c: named(c).cast("string") for c in columns_of(df, TEXT, "other") if c not in changed}
    return df.withColumns(changed) if changed else df


def to_gold(df: DataFrame) -> DataFrame:
    """Dates typed by name, then numbers by content."""
    return coerce_numbers(parse_dates(df))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the order of the given keys."""
    return df.orderBy(*[named(o) for o in order]).limit(n)


def row_sums(df: DataFrame, name: str = "row_sum") -> DataFrame:
    """`df` plus the sum over each row's numbers; a missing one counts 0."""
    parts = [F.coalesce(value_of(df.schema[c]).cast("double"), F.lit(0.0)) for c in numeric_columns(df)]
    return df.withColumn(name, reduce(add, parts, F.lit(0.0)))


def dated_history(df: DataFrame, order: str, n: int = 10, first: str = "2024-01-01") -> DataFrame:
    """(date, value): the first n row sums beside n daily dates; fewer rows give fewer dates."""
    top = row_sums(df, "__sum").orderBy(named(order)).limit(n).select(named(order).alias("key"), F.col("__sum").alias("value"))
    numbered = top.withColumn("k", F.row_number().over(Window.orderBy("key", "value")))  # n rows
    return numbered.select(F.date_add(F.lit(first).cast("date"), F.col("k") - 1).alias("date"), "value")


def fill_text(df: DataFrame, column: str, value: str = "UNKNOWN") -> DataFrame:
    return df.na.fill({column: value})


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in the given order."""
    window = Window.partitionBy(*[named(k) for k in keys]).orderBy(*[named(o) for o in order])
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def strip_amount(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, strip_symbols(named(column)))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.na.drop(subset=[column])


def number_or_drop(df: DataFrame, column: str) -> DataFrame:
    """The column as a double; rows that do not parse go."""
    return df.withColumn(column, to_number(strip_symbols(named(column).cast("string")))).where(named(column).isNotNull())
