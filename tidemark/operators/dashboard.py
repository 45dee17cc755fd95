"""Column roles, KPIs, chart recipes and insights of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_money
from tidemark.functions.types import DATE, NUMERIC, OTHER, TEXT, named, value_of
from tidemark.operators import clean
from tidemark.operators.charts import ChartRequest, grouped, measure_of
from tidemark.operators.profile import profile

#: Names of the measure that matters most, in order.
PRIORITY = ("revenue", "sales", "amount", "total", "price", "value", "units")


@dataclass(frozen=True)
class Roles:
    date: str | None
    measures: tuple[str, ...]
    dimensions: tuple[str, ...]

    @property
    def main(self) -> str | None:
        """The main measure: by priority word, then column order; else the first."""
        found = (m for w in PRIORITY for m in self.measures if w in m.lower())
        return next(found, self.measures[0] if self.measures else None)


def id_like(name: Column, extra: tuple[str, ...] = ()) -> Column:
    """The rule for roles: `id`, or a name that ends in `_id` (or in one of `extra`)."""
    low = F.lower(name)
    out = (low == "id") | low.endswith("_id")
    for suffix in extra:
        out = out | low.endswith(suffix.lower())
    return out


def column_roles(prof: DataFrame, extra_id_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(ordinal, column, role, n_distinct): role date, measure or dimension; columns without a role are left out."""
    seen = F.col("n_rows") - F.col("nulls")
    category = F.col("is_int") & (seen > 0) & (F.col("n_distinct") > 1) & ((F.col("n_distinct") <= 2) | ((F.col("n_distinct") <= 50) & (F.col("n_distinct") / seen <= 0.2)))
    first_date = F.min(F.when(F.col("class") == DATE, F.col("ordinal"))).over(Window.partitionBy())  # one row a column
    number = F.col("class").isin(NUMERIC, "bool")
    role = (
        F.when(F.col("class") == DATE, F.when(F.col("ordinal") == F.col("first_date"), "date"))
        .when(number & category, "dimension").when(number, F.when(~id_like(F.col("column"), extra_id_suffixes), "measure"))
        .when(F.col("class").isin(TEXT, OTHER) & (F.col("n_distinct") <= 30), F.when(F.col("class") == TEXT, "dimension"))
    )
    return prof.withColumn("first_date", first_date).withColumn("role", role).where("role is not null").select("ordinal", "column", "role", "n_distinct")


def roles_of(roles: DataFrame) -> Roles:
    """The roles on the driver: one row a column."""
    rows = sorted(roles.collect(), key=lambda r: r["ordinal"])
    pick = lambda role: tuple(r["column"] for r in rows if r["role"] == role)
    return Roles(next(iter(pick("date")), None), pick("measure"), pick("dimension"))


def totals(df: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """(position, label, value, format): the row count and the sum of each measure, in one pass."""
    sums = [F.coalesce(F.sum(measure_of(df, m)).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, m in enumerate(measures)]
    row = df.agg(F.count("*").cast("double").alias("n"), *sums)
    cell = lambda i, label, value, kind: F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(value).alias("value"), F.lit(kind).alias("format"))
    cells = [cell(0, "Total records", "n", "int")] + [cell(i + 1, f"Total {m}", f"s{i}", "currency" if is_money(m) else "number") for i, m in enumerate(measures)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def kpis(df: DataFrame, roles: Roles) -> DataFrame:
    return totals(df, roles.measures[:3])


def measure_totals(df: DataFrame, roles: Roles) -> DataFrame:
    """As `kpis`, over all measures."""
    return totals(df, roles.measures)


def chart_recipes(roles: Roles, n_distinct: dict[str, int]) -> list[ChartRequest]:
    """Which charts to draw; only names and counts are needed, no scan."""
    main, dims = roles.main, roles.dimensions
    if main is None:
        return [ChartRequest(dims[0], None, "count", "bar", 10, title=f"Row count by {dims[0]}")] if dims else []
    out = [ChartRequest(roles.date, main, "sum", "line", title=f"{main} over time")] if roles.date else []
    out += [ChartRequest(d, main, "sum", "bar", 10, title=f"{main} by {d}") for d in dims[:2]]
    if dims and n_distinct[dims[0]] <= 8:
        out.append(ChartRequest(dims[0], main, "sum", "pie", title=f"{main} share by {dims[0]}"))
    if not roles.date and not dims:
        out.append(ChartRequest(main, None, "none", "histogram", title=f"Distribution of {main}"))
    return out


def recipe_rows(df: DataFrame, recipes: list[ChartRequest]) -> DataFrame:
    rows = [(i, r.chart_type, r.dimension, r.measure, r.agg, r.top_n, r.title) for i, r in enumerate(recipes)]
    return df.sparkSession.createDataFrame(rows, "position int, type string, x string, y string, agg string, top_n int, title string")


def insight_leaders(df: DataFrame, roles: Roles) -> DataFrame:
    """(kind, subject, value, share): grand total, leading and lowest category of the first dimension.

    The share is of the total over all rows, also those without a category; a table whose dimension is all null
    has no leader, one with a single category no lowest.
    """
    main = roles.main
    total = df.agg(F.coalesce(F.sum(measure_of(df, main)).cast("double"), F.lit(0.0)).alias("total"))
    out = total.select(F.lit("total").alias("kind"), F.lit(main).alias("subject"), F.col("total").alias("value"), F.lit(None).cast("double").alias("share"))
    if not roles.dimensions:
        return out
    groups = grouped(df, ChartRequest(roles.dimensions[0], main)).select(F.col("x").cast("string").alias("subject"), F.col("value").cast("double").alias("value"))
    # Both ends by one aggregate: the leader has the largest sum and first name, the lowest the smallest sum and last name.
    place = F.struct((-F.col("value")).alias("minus"), "subject")
    ends = groups.where("value is not null").agg(F.min(place).alias("leader"), F.max(place).alias("lowest"))
    row = total.crossJoin(F.broadcast(ends))  # one row each
    cell = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}.subject").alias("subject"), (-F.col(f"{kind}.minus")).alias("value"))
    both = row.select("total", "leader", F.explode(F.array(cell("leader"), cell("lowest"))).alias("x")).where("x.kind = 'leader' or x.subject <> leader.subject")
    return out.unionByName(both.where("x.subject is not null").select("x.*", F.try_divide("x.value", "total").alias("share")))


def insight_trend(df: DataFrame, roles: Roles) -> DataFrame:
    """(first, last, change_pct): from the first date's sum to the last's; no row under two dates or from zero."""
    days = grouped(df, ChartRequest(roles.date, roles.main))
    row = days.agg(F.count("*").alias("n"), F.min_by("value", "x").cast("double").alias("first"), F.max_by("value", "x").cast("double").alias("last"))
    return row.where("n >= 2 and first <> 0").select("first", "last", ((F.col("last") - F.col("first")) / F.col("first") * 100).alias("change_pct"))


def insights(df: DataFrame, roles: Roles) -> DataFrame:
    """(kind, text): the insights as sentences."""
    main = roles.main
    if main is None:
        return df.sparkSession.createDataFrame([("none", "No numeric measures found to analyze.")], "kind string, text string")
    dim = roles.dimensions[0] if roles.dimensions else ""
    rows = insight_leaders(df, roles)
    text = (
        F.when(F.col("kind") == "total", F.concat(F.lit(f"Total {main} across all records is "), F.format_number("value", 2), F.lit(".")))
        .when(F.col("kind") == "leader", F.concat(F.lit("'"), F.col("subject"), F.lit(f"' leads {dim} with "), F.format_string("%.0f%%", F.coalesce("share", F.lit(0.0)) * 100), F.lit(f" of total {main}.")))
        .otherwise(F.concat(F.lit("'"), F.col("subject"), F.lit(f"' is the lowest {dim} by {main}.")))
    )
    out = rows.select("kind", text.alias("text"))
    if roles.date:
        c = F.col("change_pct")
        word = F.concat(F.lit(f"{main} trended "), F.when(c >= 0, "up").otherwise("down"), F.format_string(" %.0f%%", F.abs(c)), F.lit(" from first to last period."))
        out = out.unionByName(insight_trend(df, roles).select(F.lit("trend").alias("kind"), word.alias("text")))
    return out


@dataclass(frozen=True)
class Dashboard:
    title: str
    roles: Roles
    kpis: DataFrame
    recipes: list[ChartRequest]
    insights: DataFrame


def dashboard(df: DataFrame, title: str = "Dashboard", extra_id_suffixes: tuple[str, ...] = ()) -> Dashboard:
    """The whole specification over one profile; the recipes' data come from `charts.chart_query`."""
    found = column_roles(profile(df), extra_id_suffixes).cache()
    roles = roles_of(found)
    counts = {r["column"]: r["n_distinct"] for r in found.collect()}
    return Dashboard(title, roles, kpis(df, roles), chart_recipes(roles, counts), insights(df, roles))


def dimension_table(df: DataFrame, column: str) -> DataFrame:
    """The different values of a dimension, for a many-to-one relationship with the table."""
    c = value_of(df.schema[column])
    return df.where(c.isNotNull()).select(c.alias(column)).distinct()


def unmatched(df: DataFrame, dimension: DataFrame, column: str) -> DataFrame:
    """Rows of the table without a partner in its dimension table; a missing value needs none."""
    return df.where(named(column).isNotNull()).join(dimension, column, "left_anti")


def simple_report(df: DataFrame | None, order: str) -> DataFrame:
    """(n_rows, n_columns, n_numeric, history, error); without a source the counts are 0 and `error` says so."""
    if df is None:
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame([(0, 0, 0, "", "no source")], "n_rows long, n_columns long, n_numeric long, history string, error string")
    tidy = clean.fill_numbers(clean.parse_dates(clean.trim_names(clean.drop_empty_rows(df)), ["date"] if "date" in df.columns else []))
    days = clean.dated_history(tidy, order.strip()).agg(F.sort_array(F.collect_list(F.struct("date", "value"))).alias("d"))
    points = F.array_join(F.transform("d", lambda x: F.concat(x["date"].cast("string"), F.lit("="), x["value"].cast("decimal(38,2)").cast("string"))), ";")
    counts = tidy.agg(F.count("*").alias("n_rows"))
    numeric = len(clean.numeric_columns(tidy))
    return counts.crossJoin(F.broadcast(days)).select("n_rows", F.lit(len(tidy.columns)).cast("long").alias("n_columns"), F.lit(numeric).cast("long").alias("n_numeric"), points.alias("history"), F.lit(None).cast("string").alias("error"))
