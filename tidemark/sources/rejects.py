"""CSV with the rows kept apart that do not fit: nothing vanishes into nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.types import named
from tidemark.scratch import scratch
from tidemark.sources.tables import ESCAPE

SAMPLE_LINES = 10_000
RAW = "__raw"


def sampled_schema(spark: SparkSession, path: str, header: bool = True, lines: int = SAMPLE_LINES) -> StructType:
    """The schema of the first `lines` lines; what later rows hold otherwise is theirs to be rejected for."""
    sample = f"{scratch(spark)}/sample"
    spark.read.text(path).limit(lines).coalesce(1).write.text(sample)
    return spark.read.option("header", header).option("escape", ESCAPE).option("inferSchema", True).csv(sample).schema


@dataclass(frozen=True)
class Checked:
    """The rows that fit the schema, and (file, text, reason) of all others."""

    good: DataFrame
    rejected: DataFrame


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True) -> Checked:
    """CSV by a schema, stated or drawn from a bounded sample; every row is in one of the two results, once.

    A row is rejected for too many or too few values, or for the first column whose value is not of its type. An empty
    value is a missing one and fits any column.
    """
    schema = sampled_schema(spark, path, header) if schema is None else spark.createDataFrame([], schema).schema
    names = schema.fieldNames()
    raw = RAW
    while raw in names:
        raw += "_"
    parsed = spark.read.option("header", header).option("escape", ESCAPE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw).schema(StructType([*schema.fields, StructField(raw, StringType())])).csv(path)
    # Always true, and names every column, so that all of a row's values are converted whatever is selected from it.
    looked = F.length(F.hex(F.xxhash64(*map(named, names)))) >= 0
    texts = StructType([StructField(f"c{i}", StringType()) for i in range(len(names) + 1)])
    cells = F.from_csv(F.col(raw), texts.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "escape": ESCAPE})
    wrong = [F.when(F.col(f"cells.c{i}").isNotNull() & named(f.name).isNull(), f"{f.name} is no {f.dataType.simpleString()}") for i, f in enumerate(schema.fields)]
    short = F.size(F.split(F.col(raw), ",")) < len(names)
    reason = F.coalesce(F.when(F.col(f"cells.c{len(names)}").isNotNull(), "too many values"), *wrong, F.when(short, "too few values"), F.lit("not readable"))
    rejected = parsed.where(F.col(raw).isNotNull() & looked).withColumn("cells", cells).select(F.input_file_name().alias("file"), F.col(raw).alias("text"), reason.alias("reason"))
    return Checked(parsed.where(F.col(raw).isNull() & looked).drop(raw), rejected)
