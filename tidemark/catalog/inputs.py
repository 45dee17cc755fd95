"""Input tables, and the dirty tables that queries and their SQL derive from them in the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    return F.col(c).cast("decimal(18,2)")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing statuses, amounts and dates as text, some broken, and every tenth row twice."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("order_id"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 11 == 0, "n/a").otherwise(F.concat(F.lit("$"), money("o_totalprice").cast("string"))).alias("amount"),
        F.when(k % 13 == 0, "bad").when(k % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        F.when(k % 5 != 0, F.col("o_totalprice")).alias("total"), (k % 3 == 0).alias("flag"),
    )
    return rows.unionByName(rows.where("order_id % 10 = 0"))


DIRTY = """
d0 AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status,
         CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
         CASE WHEN o_orderkey % 13 = 0 THEN 'bad' WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS total, o_orderkey % 3 = 0 AS flag
  FROM orders),
dirty AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE order_id % 10 = 0)
"""


def sql_number(x: str) -> str:
    """Text as a double by the same guard as the library's."""
    return f"CASE WHEN regexp_full_match(trim({x}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def sql_amount(x: str) -> str:
    return sql_number(f"regexp_replace({x}, '[$,%\\s]', '', 'g')")


def sql_moment(x: str) -> str:
    shapes = [("[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d"), ("[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "%Y-%m-%d %H:%M:%S"), ("[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "%d-%m-%Y"), ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "%d/%m/%Y")]
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_full_match(trim({x}), '{r}') THEN try_strptime(trim({x}), '{f}') END" for r, f in shapes) + ")"
