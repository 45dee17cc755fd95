"""Cleaning, gold typing, recipe and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.inputs import DIRTY, dirty_orders, money, sql_amount, sql_moment, table
from tidemark.operators import clean
from tidemark.operators.health import index_hints
from tidemark.operators.profile import profile
from tidemark.plans.recipe import Step, apply_recipe, from_json, run_recipe, run_recipe_checked, to_json
from tidemark.scratch import scratch
from tidemark.sources.layout import layout_of, n_buckets, read_dates, read_keys, write_buckets, write_laid_out
from tidemark.sources.rejects import read_csv_checked
from tidemark.sources.tables import read_json, read_table, write_table


def sparse(spark, sf):
    return dirty_orders(spark, sf).select(F.when(F.col("order_id") % 4 != 0, F.col("order_id")).alias(" order_id "), F.when(F.col("order_id") % 4 != 0, F.col("status")).alias("status"))


def amounts(df):
    return df.withColumn("amount", F.round("amount", 2))


def sums(spark, sf):
    out = clean.row_sums(dirty_orders(spark, sf).select("order_id", money("total").cast("double").alias("total")), "s")
    return out.select("order_id", F.round("s", 2).alias("s"))


def export(spark, sf):
    df = dirty_orders(spark, sf).select("order_id", "amount", "status", F.array("order_id").alias("list"))
    return amounts(clean.coerce_numbers(df, "any", else_text=True)).drop("list")


RECIPE = [Step("fill_text", {"column": "status", "value": "UNKNOWN"}), Step("first_by_key", {"keys": ["order_id"], "order": ["order_date", "amount"]}), Step("number_or_drop", {"column": "amount"}), Step("parse_dates", {"columns": ["order_date"]})]


def recipe(spark, sf):
    out = apply_recipe(dirty_orders(spark, sf).select("order_id", "status", "amount", "order_date"), from_json(to_json(RECIPE)))
    return amounts(out)


def replayed(spark, sf):
    """The recipe as a job: CSV in, steps, CSV out, read again."""
    path = scratch(spark)
    source = write_table(dirty_orders(spark, sf).select("order_id", "status", "amount", "order_date"), f"{path}/in", "csv")
    run_recipe(spark, source, to_json(RECIPE), f"{path}/out")
    return amounts(read_table(spark, f"{path}/out.csv", "csv", "order_id long, status string, amount double, order_date timestamp_ntz"))


def round_trip(kind):
    def run(spark, sf):
        o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", money("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
        return read_table(spark, write_table(o, f"{scratch(spark)}/orders", kind), kind, o.schema)

    return run, "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders"


def json_array(spark, sf):
    """Files with one array of records each, as other tools write them: one for each 10,000 order numbers."""
    path = f"{scratch(spark)}/array"
    blocks = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 10_000)).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))).alias("value"))
    blocks.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string")


def rejected(spark, sf):
    """Orders as lines of text, some with a customer that is no number, a value too many or one too few, read by a schema: every row with its reason, if rejected."""
    k = F.col("o_orderkey")
    cells = [k.cast("string"), F.when(k % 9 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")), F.col("o_orderstatus"), F.when(k % 10 == 0, "P,extra").when(k % 11 != 0, "P")]
    path = f"{scratch(spark)}/lines"
    table(spark, sf, "orders").select(F.concat_ws(",", *cells).alias("value")).write.text(path)
    read = read_csv_checked(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", header=False)
    good = read.good.select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(read.rejected.select(F.split("text", ",")[0].cast("long").alias("o_orderkey"), F.lit(None).cast("long").alias("o_custkey"), "reason"))


def checked_recipe(spark, sf):
    """A recipe over a dirty file by a schema: how many rows were good, rejected and written."""
    path = scratch(spark)
    source = write_table(dirty_orders(spark, sf).select("order_id", "status", "amount", "order_date"), f"{path}/in", "csv")
    return run_recipe_checked(spark, source, to_json([Step("drop_missing", {"column": "status"})]), f"{path}/out", schema="order_id long, status string, amount string, order_date date")


def laid_out(spark, sf):
    """The events as their index hints say, in files of about a megabyte."""
    events = table(spark, sf, "events")
    layout = layout_of(events, index_hints(profile(events)), file_bytes=1 << 20)
    return write_laid_out(events, f"{scratch(spark)}/events", layout), layout


def dated_read(spark, sf):
    path, layout = laid_out(spark, sf)
    return read_dates(spark, path, layout, "2024-01-10", "2024-01-15").select("event_id", "user_id", "event_type")


def keyed_read(spark, sf):
    path, layout = laid_out(spark, sf)
    return read_keys(spark, path, layout, 200, 900).select("event_id", "user_id", "event_type")


def bucketed_join(spark, sf):
    """Lines and orders in buckets of the order's number, joined and summed without a shuffle."""
    path = scratch(spark)
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    buckets = n_buckets(orders, lines)
    orders = write_buckets(orders, f"{path}/orders", "o_orderkey", buckets)
    lines = write_buckets(lines, f"{path}/lines", "l_orderkey", buckets)
    joined = lines.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("total"))


FIRST = f"WITH {DIRTY}, f AS (SELECT * FROM dirty QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY order_date, amount) = 1) "
STEPS = FIRST + f"SELECT order_id, coalesce(status, 'UNKNOWN') AS status, round({sql_amount('amount')}, 2) AS amount, {sql_moment('order_date')} AS order_date FROM f WHERE {sql_amount('amount')} IS NOT NULL"
ENTRIES = {
    "clean_drop_empty_trim": (lambda s, d: clean.trim_names(clean.drop_empty_rows(sparse(s, d))), f"WITH {DIRTY} SELECT order_id, status FROM dirty WHERE order_id % 4 <> 0"),
    "clean_parse_dates": (lambda s, d: clean.parse_dates(dirty_orders(s, d).select("order_id", "order_date")), f"WITH {DIRTY} SELECT order_id, {sql_moment('order_date')} AS order_date FROM dirty"),
    "clean_lost_dates": (lambda s, d: clean.lost_dates(dirty_orders(s, d)), f"WITH {DIRTY} SELECT 'order_date' AS \"column\", count(*) FILTER (order_date IS NOT NULL AND {sql_moment('order_date')} IS NULL) AS lost FROM dirty"),
    "clean_fill_numbers": (lambda s, d: clean.fill_numbers(dirty_orders(s, d).select("order_id", "status", "total")), f"WITH {DIRTY} SELECT order_id, status, coalesce(total, 0) AS total FROM dirty"),
    "clean_row_sums": (sums, f"WITH {DIRTY} SELECT order_id, round(order_id + coalesce(CAST(CAST(total AS DECIMAL(18,2)) AS DOUBLE), 0), 2) AS s FROM dirty"),
    "clean_preview": (lambda s, d: clean.preview(table(s, d, "orders"), 10, "o_orderkey").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10"),
    "clean_history": (lambda s, d: clean.dated_history(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), "WITH t AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) SELECT CAST(DATE '2024-01-01' + CAST(k - 1 AS INTEGER) AS DATE) AS date, CAST(o_orderkey + o_custkey AS DOUBLE) AS value FROM t WHERE k <= 10"),
    "gold_dates_and_numbers": (lambda s, d: amounts(clean.to_gold(dirty_orders(s, d))).select("order_id", "status", "amount", "order_date"), f"WITH {DIRTY} SELECT order_id, status, round({sql_amount('amount')}, 2) AS amount, {sql_moment('order_date')} AS order_date FROM dirty"),
    "gold_export": (export, f"WITH {DIRTY} SELECT order_id, round({sql_amount('amount')}, 2) AS amount, status FROM dirty"),
    "step_fill_text": (lambda s, d: clean.fill_text(dirty_orders(s, d).select("order_id", "status"), "status"), f"WITH {DIRTY} SELECT order_id, coalesce(status, 'UNKNOWN') AS status FROM dirty"),
    "step_first_by_key": (lambda s, d: clean.first_by_key(dirty_orders(s, d), ["order_id"], ["order_date", "amount"]).select("order_id", "amount"), FIRST + "SELECT order_id, amount FROM f"),
    "step_strip_amount": (lambda s, d: clean.strip_amount(dirty_orders(s, d), "amount").select("order_id", "amount"), f"WITH {DIRTY} SELECT order_id, regexp_replace(amount, '[$,%\\s]', '', 'g') AS amount FROM dirty"),
    "step_drop_missing": (lambda s, d: clean.drop_missing(dirty_orders(s, d), "status").select("order_id"), f"WITH {DIRTY} SELECT order_id FROM dirty WHERE status IS NOT NULL"),
    "step_number_or_drop": (lambda s, d: amounts(clean.number_or_drop(dirty_orders(s, d), "amount")).select("order_id", "amount"), f"WITH {DIRTY} SELECT order_id, round({sql_amount('amount')}, 2) AS amount FROM dirty WHERE {sql_amount('amount')} IS NOT NULL"),
    "recipe_run": (recipe, STEPS),
    "recipe_replayed": (replayed, STEPS),
    **{f"io_roundtrip_{k}": round_trip(k) for k in ("csv", "json", "parquet")},
    "io_rejected_rows": (rejected, """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 11 <> 0 THEN o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 10 = 0 THEN 'too many values' WHEN o_orderkey % 9 = 0 THEN 'o_custkey is no bigint' WHEN o_orderkey % 11 = 0 THEN 'too few values' END AS reason FROM orders"""),
    "recipe_checked": (checked_recipe, f"""WITH {DIRTY}, d AS (SELECT status, regexp_full_match(order_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS good FROM dirty)
        SELECT count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_rejected, count(*) FILTER (good AND status IS NOT NULL) AS n_written FROM d"""),
    "layout_dated_read": (dated_read, "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15'"),
    "layout_keyed_read": (keyed_read, "SELECT event_id, user_id, event_type FROM events WHERE event_id BETWEEN 200 AND 900"),
    "layout_bucketed_join": (bucketed_join, "SELECT o_orderkey, o_orderstatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"),
    "io_json_array": (json_array, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"),
}
