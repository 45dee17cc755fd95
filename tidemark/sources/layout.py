"""Tables written as their index hints say, and reads that profit from it.

A date column becomes partitions (days, or months or years where days would be too many folders), the key a range
order over files whose least and largest values are kept in a manifest beside them, an id column of other tables buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.types import named

MAX_PARTS = 2_000  # partition folders of a table
FILE_BYTES = 128 << 20
BUCKET_BYTES = 128 << 20  # a bucket's rows in memory, where one task sorts them
MAX_BUCKETS = 100_000  # Spark's own bound
_FORMS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
_MANIFEST = "_manifest"  # Spark skips names that begin so when it reads a folder


@dataclass(frozen=True)
class Layout:
    """How a table lies: partitions by a date at a grain, files in ranges of a key, buckets by an id."""

    date: str | None = None
    grain: str = "day"
    key: str | None = None
    bucket: str | None = None
    files: int = 8

    @property
    def part(self) -> str | None:
        """The partition column that is added."""
        return f"{self.date}_{self.grain}" if self.date else None


def n_files(df: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Files of about `file_bytes` by the optimizer's estimate of the table's size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(100_000, -(-size // file_bytes)))


def layout_of(df: DataFrame, hints: DataFrame, max_parts: int = MAX_PARTS, file_bytes: int = FILE_BYTES) -> Layout:
    """The layout that `index_hints` rows mean for a table: one row a column, so they are read by the driver."""
    rows = hints.select("column", "kind").collect()
    order = {c: i for i, c in enumerate(df.columns)}
    first = lambda kind: min((r["column"] for r in rows if r["kind"] == kind), key=order.get, default=None)
    date, grain = first("date"), "day"
    if date:
        span = df.agg(F.min(named(date)).cast("date").alias("a"), F.max(named(date)).cast("date").alias("b")).first()
        days = (span["b"] - span["a"]).days + 1 if span["a"] else 1
        grain = "day" if days <= max_parts else "month" if days / 28 <= max_parts else "year"
    return Layout(date, grain, first("primary_key"), first("foreign_key_like"), n_files(df, file_bytes))


def _laid(df: DataFrame, layout: Layout) -> DataFrame:
    """The rows dealt as the layout says; rows without a date are a partition of their own."""
    if layout.part:
        df = df.withColumn(layout.part, F.date_format(named(layout.date), _FORMS[layout.grain]))
    by = [named(c) for c in (layout.part, layout.key) if c]
    return df.repartitionByRange(layout.files, *by).sortWithinPartitions(*by) if by else df


def write_laid_out(df: DataFrame, path: str, layout: Layout) -> str:
    """Writes Parquet by date partitions and key ranges, and the manifest (file, n, low, high) of the key."""
    laid, spark = _laid(df, layout), df.sparkSession
    if df.isEmpty():  # partitions without rows would leave no file and so no schema
        laid.limit(0).coalesce(1).write.mode("errorifexists").parquet(path)
    else:
        writer = laid.write.mode("errorifexists")
        (writer.partitionBy(layout.part) if layout.part else writer).parquet(path)
    if layout.key:
        back = spark.read.parquet(path)
        rows = back.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min(named(layout.key)).alias("low"), F.max(named(layout.key)).alias("high"))
        rows.write.parquet(f"{path}/{_MANIFEST}")
    return path


def read_dates(spark: SparkSession, path: str, layout: Layout, low: str, high: str) -> DataFrame:
    """The rows with low <= date < high (dates as text); only the partitions that may hold such are listed."""
    df, moment = spark.read.parquet(path), named(layout.date)
    form = _FORMS[layout.grain]
    part = named(layout.part).cast("string")
    within = part.between(F.date_format(F.lit(low).cast("date"), form), F.date_format(F.lit(high).cast("date"), form))
    return df.where(within & (moment >= F.lit(low).cast("timestamp_ntz")) & (moment < F.lit(high).cast("timestamp_ntz"))).drop(layout.part)


def files_between(spark: SparkSession, path: str, low, high) -> list[str]:
    """The files whose least and largest key meet low .. high, by the manifest."""
    met = spark.read.parquet(f"{path}/{_MANIFEST}").where((F.col("low") <= F.lit(high)) & (F.col("high") >= F.lit(low)))
    return sorted(r["file"] for r in met.select("file").collect())


def read_keys(spark: SparkSession, path: str, layout: Layout, low, high) -> DataFrame:
    """The rows with low <= key <= high, from the files that may hold such."""
    whole = spark.read.parquet(path)
    files = files_between(spark, path, low, high)
    df = spark.read.schema(whole.schema).option("basePath", path).parquet(*files) if files else whole.limit(0)
    out = df.where(named(layout.key).between(F.lit(low), F.lit(high)))
    return out.drop(layout.part) if layout.part else out


def n_buckets(*frames: DataFrame, least: int = 8) -> int:
    """Buckets of at most about BUCKET_BYTES for tables that are joined, by their rows and Spark's width of a row.

    The size of files would not do: how well they are compressed differs much.
    """
    most = max(df.count() * int(df._jdf.schema().defaultSize()) for df in frames)
    return max(least, min(MAX_BUCKETS, -(-most // BUCKET_BYTES)))


def write_buckets(df: DataFrame, path: str, column: str, buckets: int, name: str | None = None) -> DataFrame:
    """Writes the table in buckets of a column under a name of the session's catalog and returns it.

    Two tables with as many buckets of the keys they are joined on need no shuffle.
    """
    name = name or f"tidemark_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, named(column))  # one file a bucket, not one a task and bucket
    dealt.write.mode("errorifexists").option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    return df.sparkSession.table(name)


def exchanges(df: DataFrame) -> int:
    """Shuffles in a frame's plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def files_read(df: DataFrame) -> tuple[int, int]:
    """(files, partitions) that the scans of a frame have read, after running it; partitions only of partitioned tables."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    total = [0, 0]
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        for k, name in enumerate(("numFiles", "numPartitions")):
            if metrics.contains(name):
                total[k] += metrics.apply(name).value()
    return tuple(total)


