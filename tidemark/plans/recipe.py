"""Cleaning recipes: ordered steps that are checked against the schema, saved as JSON and replayed on new files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import clean
from tidemark.sources.rejects import read_csv_checked
from tidemark.sources.tables import read_csv, read_table, write_table

#: A step's name: its function, and which of its arguments name columns.
STEPS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "drop_empty_rows": (clean.drop_empty_rows, ()),
    "trim_names": (clean.trim_names, ()),
    "fill_numbers": (clean.fill_numbers, ()),
    "coerce_numbers": (clean.coerce_numbers, ()),
    "to_gold": (clean.to_gold, ()),
    "fill_text": (clean.fill_text, ("column",)),
    "first_by_key": (clean.first_by_key, ("keys", "order")),
    "strip_amount": (clean.strip_amount, ("column",)),
    "parse_dates": (clean.parse_dates, ("columns",)),
    "drop_missing": (clean.drop_missing, ("column",)),
    "number_or_drop": (clean.number_or_drop, ("column",)),
}


class RecipeError(ValueError):
    """The first step that fails, with its number and reason."""


@dataclass(frozen=True)
class Step:
    name: str
    args: dict = field(default_factory=dict)


def apply_recipe(df: DataFrame, steps: list[Step | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps in order on `df`, which stays as it is. A step may also be any function from DataFrame to DataFrame."""
    for i, step in enumerate(steps, 1):
        try:
            if callable(step):
                df = step(df)
                continue
            if step.name not in STEPS:
                raise RecipeError(f"unknown step; one of {', '.join(STEPS)}")
            function, column_args = STEPS[step.name]
            for arg in column_args:
                wanted = step.args.get(arg) or []
                for c in [wanted] if isinstance(wanted, str) else wanted:
                    if c not in df.columns:
                        raise RecipeError(f"no column {c!r}; there are {', '.join(df.columns)}")
            df = function(df, **step.args)
        except Exception as e:
            raise RecipeError(f"step {i} ({getattr(step, 'name', 'function')}): {e}") from e
    return df


def to_json(steps: list[Step]) -> str:
    return json.dumps([{"step": s.name, **s.args} for s in steps])


def from_json(text: str) -> list[Step]:
    return [Step(s["step"], {k: v for k, v in s.items() if k != "step"}) for s in json.loads(text)]


def run_recipe(spark: SparkSession, source: str, recipe: str, target: str, kind: str = "csv") -> DataFrame:
    """Reads a CSV, applies a recipe in JSON and writes the result; returns it."""
    out = apply_recipe(read_csv(spark, source), from_json(recipe))
    write_table(out, target, kind)
    return out


def run_recipe_checked(spark: SparkSession, source: str, recipe: str, target: str, kind: str = "csv", schema: StructType | str | None = None) -> DataFrame:
    """As `run_recipe`, with rows that do not fit written to `<target>_rejected` as Parquet; returns one row (n_good, n_rejected, n_written).

    The schema is stated or drawn from a sample. Good and rejected rows are all of the file's.
    """
    read = read_csv_checked(spark, source, schema)
    out = apply_recipe(read.good, from_json(recipe))
    path = write_table(out, target, kind)
    read.rejected.write.mode("overwrite").parquet(f"{target}_rejected")
    good = read.good.agg(F.count("*").alias("n_good"))
    rejected = spark.read.parquet(f"{target}_rejected").agg(F.count("*").alias("n_rejected"))
    written = read_table(spark, path, kind, out.schema).agg(F.count("*").alias("n_written"))
    return good.crossJoin(F.broadcast(rejected)).crossJoin(F.broadcast(written))  # one row each
