"""Reading and writing tables: CSV, JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("csv", "parquet", "json")
ESCAPE = '"'  # a quote inside a quoted value is doubled


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; types are inferred in a pass of its own unless `schema` is given."""
    reader = spark.read.option("header", True).option("escape", ESCAPE)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = False) -> DataFrame:
    """JSON: an array of records in each file, or one record a line with `lines`, which Spark can split."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_table(spark: SparkSession, path: str, kind: str, schema: StructType | str | None = None) -> DataFrame:
    kind = known_format(kind)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "json":
        return read_json(spark, path, schema, lines=True)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def known_format(kind: str) -> str:
    found = kind.strip().lower()
    if found not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(FORMATS)}")
    return found


def write_table(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> str:
    """Writes to `path` with the format's extension and returns that path. CSV has a header, JSON one record a line."""
    kind = known_format(kind)
    target = f"{path}.{kind}"
    writer = df.write.mode(mode)
    (writer.option("header", True).option("escape", ESCAPE) if kind == "csv" else writer).format(kind).save(target)
    return target


def demo_orders(spark: SparkSession) -> DataFrame:
    """Five dirty orders to try things on."""
    #: The demo rows.
    rows = [
        (101, "C-001", "North", "2026-01-03", "$120.5", "completed"),
        (102, None, "North", "2026-01-05", "$80.0", "completed"),
        (103, "C-003", "South", "bad-date", "$330.0", "pending"),
        (103, "C-003", "South", "2026-01-08", "$330.0", "pending"),
        (104, "C-005", "West", "2026-01-10", "$95.0", "completed"),
    ]
    return spark.createDataFrame(rows, "order_id long, customer_id string, region string, order_date string, amount string, status string")
