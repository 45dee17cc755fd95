"""Evaluation of data-quality rules on a new load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.types import named, value_of


def null_rate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(column, baseline_pct, null_pct, limit_pct, broken) from two profiles, for columns that had nulls."""
    old = baseline.where("null_pct > 0").select("column", F.col("null_pct").alias("baseline_pct"))
    both = old.join(current.select("column", "null_pct"), "column")
    limit = F.greatest(F.lit(1), F.bround("baseline_pct", 0).cast("int"))
    return both.select("column", "baseline_pct", "null_pct", limit.alias("limit_pct"), (F.col("null_pct") > limit).alias("broken"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that occur more than once."""
    return df.groupBy(named(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def key_is_unique(df: DataFrame, key: str) -> DataFrame:
    out = df.agg(F.count("*").alias("n_rows"), F.count_distinct(named(key)).alias("n_distinct"))
    return out.withColumn("broken", F.col("n_rows") > F.col("n_distinct"))


def freshness(df: DataFrame, moment: str, as_of: str, days: int = 2) -> DataFrame:
    """(latest, broken): whether the latest moment lies more than `days` before `as_of`; an empty table is stale."""
    latest = df.agg(F.max(named(moment)).cast("timestamp_ntz").alias("latest"))
    line = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    return latest.withColumn("broken", F.coalesce(F.col("latest") < line, F.lit(True)))


def every_day(days: DataFrame) -> DataFrame:
    """(day, n) for every day from the first to the last of `days` (day, n), days without rows with 0."""
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def day_counts(df: DataFrame, moment: str) -> DataFrame:
    return df.where(named(moment).isNotNull()).groupBy(named(moment).cast("date").alias("day")).agg(F.count("*").alias("n"))


def daily_volume(df: DataFrame, moment: str) -> DataFrame:
    return every_day(day_counts(df, moment))


def drops_of(days: DataFrame, share: float = 0.5, days_before: int = 7) -> DataFrame:
    """(day, n, usual, broken): a day under `share` of the mean of the days before it. The window runs over days, not rows."""
    before = Window.orderBy("day").rowsBetween(-days_before, -1)
    out = every_day(days).withColumn("usual", F.avg("n").over(before))
    return out.withColumn("broken", F.coalesce(F.col("n") < share * F.col("usual"), F.lit(False)))


def volume_drops(df: DataFrame, moment: str, share: float = 0.5, days: int = 7) -> DataFrame:
    return drops_of(day_counts(df, moment), share, days)


def outliers(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Rows with a value outside mean +/- k standard deviations, with `outlier_columns`."""
    c = {name: value_of(df.schema[name]).cast("double") for name in columns}
    stats = df.agg(*[f(x).alias(f"{n}_{i}") for i, x in enumerate(c.values()) for n, f in (("__mean", F.avg), ("__std", F.stddev_samp))])
    far = [F.when(F.abs(x - F.col(f"__mean_{i}")) > k * F.col(f"__std_{i}"), F.lit(name)) for i, (name, x) in enumerate(c.items())]
    out = df.crossJoin(F.broadcast(stats)).withColumn("outlier_columns", F.array_join(F.array_compact(F.array(*far)), ","))  # one row of statistics
    return out.where("outlier_columns <> ''").select(*[named(x) for x in df.columns], "outlier_columns")
