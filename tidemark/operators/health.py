"""Health, issues, keys and rule suggestions: expressions over the column profile and the duplicate count."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import missing_as_null, named
from tidemark.operators.profile import id_like_loose, profile


def duplicate_rows(df: DataFrame, by_hash: bool = True, hash_of=F.xxhash64) -> DataFrame:
    """One row `duplicates`: copies after the first; missing values equal each other.

    With `by_hash` a first grouping by a hash of the row, which shuffles one number a row, finds the hashes that occur
    again; only rows that have one of these are compared themselves, within their hash. Without it all rows are. The
    result is exact either way. Map columns count by their entries.
    """
    clean = missing_as_null(df)
    keys = [F.map_entries(named(f.name)) if f.dataType.typeName() == "map" else named(f.name) for f in clean.schema.fields]
    if not keys:
        groups = clean.agg(F.count("*").alias("n"))
    else:
        rows = clean.select(hash_of(*keys).alias("h"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
        if by_hash:
            again = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
            rows = rows.join(again, "h", "left_semi")
        groups = rows.groupBy("h", *[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def health(prof: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: score, grade, four percentages, duplicate_rows, columns_with_nulls, n_pii, pii_columns."""
    sums = prof.agg(
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_columns"),
        F.count_if(F.col("nulls") > 0).alias("columns_with_nulls"), F.count_if("is_pii").alias("n_pii"),
        F.sort_array(F.collect_list(F.when(F.col("is_pii"), F.struct("ordinal", "column")))).alias("pii"),
    )
    row = sums.crossJoin(F.broadcast(duplicates))  # one row each
    cells = F.greatest(F.col("n_rows") * F.col("n_columns"), F.lit(1))
    row = row.withColumns({
        "completeness": (1 - F.col("nulls") / cells) * 100,
        "uniqueness": F.coalesce((1 - F.try_divide("duplicates", "n_rows")) * 100, F.lit(100.0)),
        "quality": (1 - F.col("columns_with_nulls") / F.greatest("n_columns", F.lit(1))) * 100,
        "privacy": F.greatest(F.lit(0.0), 100.0 - F.col("n_pii") * 25),
    })
    score = F.bround(0.35 * F.col("completeness") + 0.25 * F.col("uniqueness") + 0.25 * F.col("quality") + 0.15 * F.col("privacy"), 0).cast("int")
    return row.select(
        score.alias("score"), F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D").alias("grade"),
        F.bround("completeness", 1).alias("completeness_pct"), F.bround("uniqueness", 1).alias("uniqueness_pct"), F.bround("quality", 1).alias("column_quality_pct"),
        F.bround("privacy", 1).alias("privacy_score"), F.col("duplicates").alias("duplicate_rows"), "columns_with_nulls", "n_pii", F.array_join(F.transform("pii", lambda x: x["column"]), ", ").alias("pii_columns"),
    )


def cards(h: DataFrame) -> DataFrame:
    """(position, label, value, status, detail): five status cards of a health row."""
    def status(good, warn):
        return F.when(good, "good").when(warn, "warn").otherwise("bad")

    def card(i, label, value, good, warn, detail):
        return F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), value.alias("value"), status(good, warn).alias("status"), detail.alias("detail"))

    c, text = F.col, lambda x: F.col(x).cast("string")
    #: Labels and details of the cards.
    personal = F.when(c("n_pii") == 0, "No obvious PII detected.").otherwise(c("pii_columns"))
    return h.select(F.explode(F.array(
        card(1, "Health score", F.concat(text("score"), F.lit("/100 ("), c("grade"), F.lit(")")), c("score") >= 90, c("score") >= 75, F.lit("Weighted data-quality score.")),
        card(2, "Completeness", F.concat(text("completeness_pct"), F.lit("%")), c("completeness_pct") >= 98, c("completeness_pct") >= 90, F.lit("Share of non-null cells.")),
        card(3, "Duplicate rows", text("duplicate_rows"), c("duplicate_rows") == 0, c("duplicate_rows") <= 2, F.lit("Fully duplicated rows.")),
        card(4, "Cols with nulls", text("columns_with_nulls"), c("columns_with_nulls") == 0, c("columns_with_nulls") <= 2, F.lit("Columns containing missing values.")),
        card(5, "PII columns", text("n_pii"), c("n_pii") == 0, c("n_pii") <= 1, personal),
    )).alias("x")).select("x.*")


def issues(prof: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(id, severity, count, action, title, detail): missing values, personal data, duplicate rows, numbers kept as text."""
    def rows(source, kind, severity, count, action, title, *detail):
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in detail])
        return source.select(
            F.concat(F.lit(f"{kind}_"), F.col("column")).alias("id"), severity.alias("severity"), count.cast("long").alias("count"), F.lit(action).alias("action"),
            F.concat(F.lit(f"{title}: "), F.col("column")).alias("title"), text.alias("detail"),
        )

    p = F.col("null_pct")
    #: The actions.
    nulls = rows(prof.where(p > 0), "nulls", F.when(p >= 20, "High").when(p >= 5, "Medium").otherwise("Low"), F.col("nulls"), "Fill with default / drop rows", "Missing values", p, "% of the values are missing")
    pii = rows(prof.where("is_pii"), "pii", F.lit("High"), F.col("n_distinct"), "Mask / anonymize before storing", "Personal data", "its name or its values look personal")
    casts = rows(prof.where("number_like"), "cast", F.lit("Low"), F.col("number_seen"), "Cast to a numeric type", "Numbers kept as text", F.col("number_seen"), " values read as numbers")
    copies = duplicates.where("duplicates > 0").select(F.lit("dup_rows").alias("id"), F.when(F.col("duplicates") <= 2, "Medium").otherwise("High").alias("severity"), F.col("duplicates").cast("long").alias("count"), F.lit("Drop duplicates").alias("action"), F.lit("Repeated rows").alias("title"), F.concat(F.col("duplicates").cast("string"), F.lit(" rows occur again")).alias("detail"))
    return nulls.unionByName(pii).unionByName(copies).unionByName(casts)


def primary_key(prof: DataFrame) -> DataFrame:
    """One row `column` (none without a candidate): the first unique, complete column, id-like names first."""
    return prof.where("is_pk_candidate").orderBy(F.desc(id_like_loose(F.col("column"))), "ordinal").limit(1).select("column")


def _with_key(prof: DataFrame) -> DataFrame:
    return prof.join(F.broadcast(primary_key(prof).select(F.col("column").alias("pk"))), how="left")


def index_hints(prof: DataFrame) -> DataFrame:
    """(column, kind, layout): the key, other id-like columns, dates; with what Spark makes of each."""
    kind = F.when(F.col("column") == F.col("pk"), "primary_key").when(id_like_loose(F.col("column")), "foreign_key_like").when(F.col("sql_type").contains("DATETIME"), "date")
    layout = F.when(F.col("kind") == "date", "partition by day").when(F.col("kind") == "primary_key", "sort within files").otherwise("bucket for joins")
    return _with_key(prof).withColumn("kind", kind).where("kind is not null").select("column", "kind", layout.alias("layout"))


def column_declarations(prof: DataFrame) -> DataFrame:
    """(ordinal, declaration, is_key)."""
    word = F.concat(F.col("column"), F.lit(" "), F.col("sql_type"), F.when(F.col("nulls") == 0, " NOT NULL").otherwise(" NULL"))
    return _with_key(prof).select("ordinal", word.alias("declaration"), F.coalesce(F.col("column") == F.col("pk"), F.lit(False)).alias("is_key"))


def create_table(df: DataFrame, prof: DataFrame, name: str) -> str:
    """A Spark CREATE TABLE statement with the columns that never were null as NOT NULL."""
    full = {r["column"] for r in prof.where("nulls = 0").select("column").collect()}
    lines = [f"  `{f.name}` {f.dataType.simpleString().upper()}" + " NOT NULL" * (f.name in full) for f in df.schema.fields]
    return f"CREATE TABLE `{safe_name(name)}` (\n" + ",\n".join(lines) + "\n) USING PARQUET"


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_") or "ingested_data"


#: Why a kind of rule is worth watching.
RATIONALE = {
    "Completeness": "later loads may miss more values than this one", "Uniqueness": "a key names one row", "Timeliness": "new rows should keep coming",
    "Volume": "a load may have been cut short", "Validity": "values far from the usual ones are often errors",
}


def rule_rows(prof: DataFrame) -> DataFrame:
    """(name, type, severity, condition, rationale): rules worth watching on later loads."""
    keyed = _with_key(prof)
    p = F.col("null_pct")

    def rows(source, name, kind, severity, condition):
        return source.select(name.alias("name"), F.lit(kind).alias("type"), severity.alias("severity"), condition.alias("condition"), F.lit(RATIONALE[kind]).alias("rationale"))

    column, c = F.col("column"), F.concat
    first_date = prof.where("sql_type = 'DATETIME2'").orderBy("ordinal").limit(1)
    number = prof.where((F.col("class") == "numeric") & ~id_like_loose(column)).orderBy("ordinal").limit(1)
    limit = F.greatest(F.lit(1), F.bround(p, 0).cast("int")).cast("string")
    out = rows(prof.where(p > 0), c(F.lit("Null rate: "), column), "Completeness", F.when(p >= 20, "High").otherwise("Medium"), c(F.lit("null_rate("), column, F.lit(") > "), limit, F.lit("%")))
    out = out.unionByName(rows(keyed.where("column = pk"), c(F.lit("Duplicate key: "), column), "Uniqueness", F.lit("High"), c(F.lit("COUNT(*) > COUNT(DISTINCT "), column, F.lit(")"))))
    out = out.unionByName(rows(first_date, c(F.lit("Freshness: "), column), "Timeliness", F.lit("Medium"), c(F.lit("MAX("), column, F.lit(") < TODAY - 2 days"))))
    out = out.unionByName(rows(prof.sparkSession.range(1), F.lit("Row volume drop"), "Volume", F.lit("Medium"), F.lit("daily_row_count < 0.5 * 7day_avg")))
    return out.unionByName(rows(number, c(F.lit("Outliers: "), column), "Validity", F.lit("Low"), c(column, F.lit(" outside mean +/- 3*stddev"))))


@dataclass(frozen=True)
class Report:
    """A table's health report; each part is a small DataFrame over one cached profile."""

    profile: DataFrame
    health: DataFrame
    cards: DataFrame
    issues: DataFrame
    primary_key: DataFrame
    indexes: DataFrame
    declarations: DataFrame
    rules: DataFrame


def report(df: DataFrame, sample_order: str | None = None) -> Report:
    prof = profile(df, sample_order=sample_order).cache()
    copies = duplicate_rows(df).cache()
    h = health(prof, copies).cache()
    return Report(prof, h, cards(h), issues(prof, copies), primary_key(prof), index_hints(prof), column_declarations(prof), rule_rows(prof))
