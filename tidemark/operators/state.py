"""Profiles as state: what each load of a table adds is kept in two small tables and merged, so that a new load reads only itself.

A load's column state is one row a column: counts, extremes, mean and spread, pattern hits, sketches. Its day state is one
row for each date column and day. Merging adds, takes the extremes, unites the sketches; it is associative and
commutative, so states of loads, of merged loads, or of parts of a load meet in any order. Profiles and rules are read
off merged states. What cannot be merged exactly, the number of different values and quartiles, is a sketch's estimate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import DATE, NUMERIC, OTHER, TEXT, named, type_class, value_of
from tidemark.operators.profile import PATTERNS, column_rows, measures, pct, read_off

LG_K = 14  # the distinct sketch's error is about 0.8 %
COLUMN, DAYS = "column_state", "day_state"


def _column_measures(field: T.StructField) -> dict[str, Column]:
    """What is kept of a column besides the profile's own measures."""
    c, kind = value_of(field), type_class(field.dataType)
    number = c.cast("double") if kind == NUMERIC else F.lit(None).cast("double")
    moment = named(field.name).cast("timestamp_ntz") if kind == DATE else F.lit(None).cast("timestamp_ntz")
    hashed = F.lit(None).cast("long") if kind == OTHER else F.xxhash64(c)
    text = c if kind == TEXT else F.lit(None).cast("string")
    seen = F.when(c.isNotNull(), hashed)
    return {
        "n_numbers": F.count(number), "mean": F.avg(number), "m2": F.coalesce(F.var_pop(number) * F.count(number), F.lit(0.0)), "low": F.min(number), "high": F.max(number),
        "first_text": F.min(F.left(text, F.lit(200))), "last_text": F.max(F.left(text, F.lit(200))), "first_moment": F.min(moment), "last_moment": F.max(moment),
        "distinct": F.hll_sketch_agg(seen, F.lit(LG_K)), "quantiles": F.kll_sketch_agg_double(number),
    }


def column_state(df: DataFrame) -> DataFrame:
    """One row a column: what merges of a table's columns, from one pass."""
    fields = df.schema.fields
    cells = [measures(f, True) | _column_measures(f) for f in fields]
    return column_rows(df, cells)


def day_state(df: DataFrame) -> DataFrame:
    """(column, day, n) of each date column, days without rows left out; one pass."""
    dates = [f.name for f in df.schema.fields if type_class(f.dataType) == DATE]
    if not dates:
        return df.sparkSession.createDataFrame([], "column string, day date, n long")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("date").alias("day")) for c in dates]))
    return df.select(cells.alias("x")).select("x.*").where("day is not null").groupBy("column", "day").agg(F.count("*").alias("n"))


def merged(*states: DataFrame) -> DataFrame:
    """The column state of all that the given states are of. Columns that some loads lack, or have in another type, are told apart by name and type."""
    rows = reduce(lambda a, b: a.unionByName(b), states)
    n, mean, m2 = F.col("n_numbers"), F.col("mean"), F.col("m2")
    rows = rows.withColumn("weighted", mean * n)
    total, center = F.sum("n_numbers"), F.sum("weighted") / F.nullif(F.sum("n_numbers"), F.lit(0))
    sums = ["n_rows", "nulls", "n_numbers", *PATTERNS]
    least, most = ("low", "first_text", "first_moment"), ("max_len", "max_abs", "high", "last_text", "last_moment")
    # The spread of all is the spread within the parts and that of their means.
    between = F.sum(n * mean * mean) - total * center * center
    out = rows.groupBy("column", "dtype").agg(
        F.min("ordinal").alias("ordinal"), *[F.first(c).alias(c) for c in ("class", "name_pii", "is_int")], *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most], center.alias("mean"), (F.sum(m2) + F.coalesce(F.greatest(between, F.lit(0.0)), F.lit(0.0))).alias("m2"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    return out.select(*states[0].columns)


def merged_days(*states: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), states).groupBy("column", "day").agg(F.sum("n").alias("n"))


def profile_of(state: DataFrame) -> DataFrame:
    """The profile of all that the state is of; distinct counts are estimates, so no column is called a key."""
    cells = state.withColumn("n_distinct", F.hll_sketch_estimate("distinct"))
    return read_off(cells).withColumn("is_pk_candidate", F.lit(None).cast("boolean"))


def numbers(state: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, max, p25, p50, p75, n_distinct) of the numeric columns; the last four are estimates."""
    spread = F.when(F.col("n_numbers") > 1, F.sqrt(F.col("m2") / (F.col("n_numbers") - 1)))
    at = lambda q: F.when(F.col("n_numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(q)))
    return state.where(F.col("class") == NUMERIC).select(
        "column", F.col("n_numbers").alias("count"), "mean", spread.alias("std"), F.col("low").alias("min"), F.col("high").alias("max"),
        at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.hll_sketch_estimate("distinct").alias("n_distinct"),
    )


class StateStore:
    """The states of a table's loads under a path; each load is written once, whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, load: str, df: DataFrame) -> None:
        """Reads a new load, and only it. A load that is there already is refused."""
        df.sparkSession.createDataFrame([(load,)], "load string").write.mode("errorifexists").parquet(f"{self.path}/loads/load={load}")
        column_state(df).write.parquet(f"{self.path}/{COLUMN}/load={load}")
        day_state(df).write.parquet(f"{self.path}/{DAYS}/load={load}")

    def _read(self, kind: str, loads: tuple[str, ...]) -> DataFrame:
        df = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*([f"{self.path}/{kind}/load={x}" for x in loads] or [f"{self.path}/{kind}"]))
        return df.drop("load")

    def columns(self, *loads: str) -> DataFrame:
        """The merged column state of the loads, of all without any."""
        return merged(self._read(COLUMN, loads))

    def days(self, *loads: str) -> DataFrame:
        return merged_days(self._read(DAYS, loads))


def null_rates(state: DataFrame) -> DataFrame:
    """(column, null_pct) as the rule on null rates takes it."""
    return state.select("column", pct(F.col("nulls"), F.col("n_rows")).alias("null_pct"))


def freshness(state: DataFrame, column: str, as_of: str, days: int = 2) -> DataFrame:
    """(latest, broken) as `rules.freshness`, from the state alone."""
    latest = state.where(F.col("column") == column).agg(F.max("last_moment").alias("latest"))
    line = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    return latest.withColumn("broken", F.coalesce(F.col("latest") < line, F.lit(True)))


def outlier_limits(state: DataFrame, k: float = 3.0) -> DataFrame:
    """(column, low, high): between which values a later load's numbers are usual, for `outside`."""
    return numbers(state).where("std is not null").select("column", (F.col("mean") - k * F.col("std")).alias("low"), (F.col("mean") + k * F.col("std")).alias("high"))


def outside(df: DataFrame, limits: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a new load with a value outside the limits of earlier loads, with `outlier_columns`; one scan of the load alone."""
    wanted = limits.where(F.col("column").isin(*columns)).collect()  # a row a column
    far = [F.when(~value_of(df.schema[r["column"]]).cast("double").between(r["low"], r["high"]), F.lit(r["column"])) for r in sorted(wanted, key=lambda r: columns.index(r["column"]))]
    out = df.withColumn("outlier_columns", F.array_join(F.array_compact(F.array(*far)), ",") if far else F.lit(""))
    return out.where("outlier_columns <> ''")


