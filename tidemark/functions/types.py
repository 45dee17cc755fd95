"""Type classes, the normal form of missing values, and parsing of text into numbers and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOL, NUMERIC, DATE, TEXT, OTHER = "bool", "numeric", "date", "text", "other"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "d-M-yyyy", "d/M/yyyy")


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.NumericType):
        return NUMERIC
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    return TEXT if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else OTHER


def columns_of(df: DataFrame, *classes: str) -> list[str]:
    return [f.name for f in df.schema.fields if type_class(f.dataType) in classes]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers without booleans."""
    return columns_of(df, NUMERIC)


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_of(field: T.StructField) -> Column:
    """The column with NaN as null: both count as missing."""
    c = named(field.name)
    return F.when(~F.isnan(c), c) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c


def missing_as_null(df: DataFrame) -> DataFrame:
    return df.select([value_of(f).alias(f.name) for f in df.schema.fields])


def to_number(c: Column) -> Column:
    """Text as a double; null unless the whole text is a plain or scientific number."""
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double"))


def strip_symbols(c: Column) -> Column:
    """Without dollar, comma, percent and white space."""
    return F.regexp_replace(c, r"(?U)[$,%\s]", "")


def shape_of(form: str) -> str:
    """What texts of a date format look like: letters as so many digits, one or two where the letter stands alone."""
    digits = lambda m: r"\d{1,2}" if len(m[0]) == 1 else rf"\d{{{len(m[0])}}}"
    return "^" + re.sub(r"([A-Za-z])\1*", digits, form) + r"\z"


def to_moment(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Text as a timestamp by the first format that fits, ISO first; else null.

    Only texts that look like a format are parsed by it, since a failed parse costs far more than a look. Formats
    are of digits and marks.
    """
    text = F.trim(c)
    tried = F.coalesce(*[F.when(text.rlike(shape_of(f)), F.try_to_timestamp(text, F.lit(f))) for f in formats])
    longest = max(map(len, formats)) + 2
    return F.when(F.length(text).between(min(map(len, formats)), longest), tried).cast("timestamp_ntz")
