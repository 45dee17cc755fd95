"""Exact quantiles by rank selection: no task holds a column's values.

Every wanted rank has a bracket, at first the least and the largest value. A pass over the table counts the values of
each bracket in bins, with the least and largest value of each bin; the bin that holds the rank is the next bracket. Bins
are equal parts of the bracket, of logarithms where it spans magnitudes; as their places never fall while values rise,
the values between a bin's least and largest are those of the bin. Brackets of few rows are counted value by value,
which ends the search. All columns and ranks share each pass. The driver sees one row for each column and rank.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.types import value_of

BINS = 4096
FIT = 100_000  # rows of a bracket that are counted value by value
_MOST = 1.7976931348623157e308


@dataclass(frozen=True)
class Bracket:
    """Values from low to high of a column, of which `before` are smaller than low, and how many there are."""

    column: int
    low: float
    high: float
    before: int
    n: int

    @property
    def whole(self) -> bool:
        """Whether its values are counted one by one: few, or such that bins do not part them."""
        return self.n <= FIT or _finite(self.low) == _finite(self.high)

    @property
    def by_magnitude(self) -> bool:
        a, b = _finite(self.low), _finite(self.high)
        return b / 4 - a / 4 > max(abs(a), abs(b)) / 8

    def bin(self, y: Column) -> Column:
        place = lambda v: math.copysign(math.log1p(abs(v)), v) if self.by_magnitude else v
        y = F.least(F.greatest(y, F.lit(-_MOST)), F.lit(_MOST))
        y = F.signum(y) * F.log1p(F.abs(y)) if self.by_magnitude else y
        a, b = place(_finite(self.low)), place(_finite(self.high))
        # The share may come out a little below 0 or above 1 where logarithms differ in the last digit.
        return F.least(F.greatest(F.floor((y - F.lit(a)) / F.lit(b - a) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _finite(v: float) -> float:
    return min(max(v, -_MOST), _MOST)


def _pass(df: DataFrame, values: list[Column], wanted: dict[Bracket, list[int]]) -> list[tuple[Bracket, int, Bracket]]:
    """For each bracket and rank (counted within the column) the bin that holds the rank."""
    brackets = list(wanted)
    cells = []
    for i, b in enumerate(brackets):
        y = values[b.column]
        bin, single = (F.lit(None).cast("int"), y) if b.whole else (b.bin(y), F.lit(None).cast("double"))
        cells.append(F.when(y.between(F.lit(b.low), F.lit(b.high)), F.struct(F.lit(i).alias("slot"), bin.alias("bin"), single.alias("single"), y.alias("y"))))
    rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
    bins = rows.groupBy("slot", "bin", "single").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("slot").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = df.sparkSession.createDataFrame([(i, r - b.before, r) for i, b in enumerate(brackets) for r in wanted[b]], "slot int, within long, rank long")
    held = bins.withColumn("before", before).join(F.broadcast(ranks), "slot").where("before <= within and within < before + n")
    return [(brackets[r["slot"]], r["rank"], Bracket(brackets[r["slot"]].column, r["low"], r["high"], brackets[r["slot"]].before + r["before"], r["n"])) for r in held.collect()]


def values_at(df: DataFrame, columns: list[str], ranks: dict[str, list[int]], extent: dict[str, tuple[int, float, float]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of the sorted columns, missing values left out. `extent`: count, least and largest value."""
    values = [value_of(df.schema[c]).cast("double") for c in columns]
    wanted: dict[Bracket, list[int]] = {}
    found: dict[tuple[str, int], float] = {}

    def open_(bracket: Bracket, rank: int) -> None:
        if bracket.low == bracket.high:
            found[columns[bracket.column], rank] = bracket.low
        else:
            wanted.setdefault(bracket, []).append(rank)

    for i, c in enumerate(columns):
        n, low, high = extent[c]
        for rank in set(ranks[c]):
            open_(Bracket(i, low, high, 0, n), rank)
    while wanted:
        held, wanted = _pass(df, values, wanted), {}
        for _, rank, bracket in held:
            open_(bracket, rank)
    return found


def quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], extent: dict[str, tuple[int, float, float]] | None = None) -> DataFrame:
    """(column, quantiles): for each share the value at that part of the ranks, between two ranks by interpolation.

    A column without values has nulls. NaN is missing; infinite values are values.
    """
    if extent is None:
        values = {c: value_of(df.schema[c]).cast("double") for c in columns}
        row = df.agg(*[f(y).alias(f"{n}_{i}") for i, y in enumerate(values.values()) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first() if columns else None
        extent = {c: (row[f"n_{i}"], row[f"low_{i}"], row[f"high_{i}"]) for i, c in enumerate(columns)}
    places = {c: [(extent[c][0] - 1) * s for s in shares] for c in columns if extent[c][0]}
    ranks = {c: [r for p in found for r in (math.floor(p), math.ceil(p))] for c, found in places.items()}
    at = values_at(df, list(places), ranks, extent)

    def between(c: str, p: float) -> float:
        low, high = at[c, math.floor(p)], at[c, math.ceil(p)]
        return low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high

    rows = [(c, [between(c, p) for p in places[c]] if c in places else [None] * len(shares)) for c in columns]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("column", T.StringType()), T.StructField("quantiles", T.ArrayType(T.DoubleType()))]))
