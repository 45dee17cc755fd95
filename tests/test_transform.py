"""Cleaning steps, recipes and files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean
from tidemark.plans.recipe import RecipeError, Step, apply_recipe, from_json, run_recipe, to_json
from tidemark.sources.tables import demo_orders, read_json, read_table, write_table


def test_gold_of_the_demo(spark):
    gold = clean.to_gold(demo_orders(spark))
    rows = gold.orderBy("order_id", "order_date").collect()
    assert round(sum(r["amount"] for r in rows), 2) == 955.5
    assert sorted((r["order_date"].day if r["order_date"] else 0) for r in rows) == [0, 3, 5, 8, 10]
    assert dict(gold.dtypes)["customer_id"] == "string"


def test_default_recipe(spark):
    steps = [Step("fill_text", {"column": "customer_id"}), Step("first_by_key", {"keys": ["order_id"], "order": ["order_date"]}), Step("number_or_drop", {"column": "amount"}), Step("parse_dates", {"columns": ["order_date"]})]
    out = apply_recipe(demo_orders(spark), from_json(to_json(steps)))
    assert out.count() == 4 and out.agg(F.sum("amount")).first()[0] == 625.5
    assert out.where("customer_id = 'UNKNOWN'").count() == 1


def test_dirty_sales(spark):
    df = spark.createDataFrame([("Juan", "$1200", "2026-01-01"), ("Maria", "$500", "2026-01-02"), (None, "$3000", "2026-01-03"), ("Carlos", "invalido", "2026-01-04")], "Cliente string, Monto_Venta string, Fecha string")
    out = apply_recipe(df, [Step("drop_missing", {"column": "Cliente"}), Step("number_or_drop", {"column": "Monto_Venta"}), lambda d: d.withColumn("x", F.lit(1))])
    assert [(r["Cliente"], r["Monto_Venta"]) for r in out.orderBy("Cliente").collect()] == [("Juan", 1200.0), ("Maria", 500.0)]


def test_recipe_errors_name_the_step(spark):
    with pytest.raises(RecipeError, match="step 2 .*no column 'nope'"):
        apply_recipe(demo_orders(spark), [Step("fill_numbers"), Step("fill_text", {"column": "nope"})])
    with pytest.raises(RecipeError, match="step 1 .*unknown step"):
        apply_recipe(demo_orders(spark), [Step("explode")])


@pytest.mark.parametrize("text,want", [("1e5", 1e5), ("+5", 5.0), ("5.", 5.0), ("-.5", -0.5), ("1d", None), ("1_000", None), ("0x10", None), ("", None), ("inf", None), (" 7 ", 7.0)])
def test_numbers(spark, text, want):
    from tidemark.functions.types import to_number

    assert spark.range(1).select(to_number(F.lit(text)).alias("x")).first()[0] == want


@pytest.mark.parametrize("text,want", [("2026-01-13", dt.datetime(2026, 1, 13)), ("05-02-2010", dt.datetime(2010, 2, 5)), ("5/2/2010", dt.datetime(2010, 2, 5)), ("bad-date", None), ("2026-01-13 10:20:30", dt.datetime(2026, 1, 13, 10, 20, 30))])
def test_dates(spark, text, want):
    from tidemark.functions.types import to_moment

    assert spark.range(1).select(to_moment(F.lit(text)).alias("x")).first()[0] == want


def test_simple_steps(spark):
    df = spark.createDataFrame([(None, None, None), (1, float("nan"), "b"), (2, 3.0, "a")], "` a ` long, v double, t string")
    tidy = clean.trim_names(clean.drop_empty_rows(df))
    assert tidy.columns == ["a", "v", "t"] and tidy.count() == 2
    assert sorted(r["s"] for r in clean.row_sums(tidy, "s").collect()) == [1.0, 5.0]
    assert [r["a"] for r in clean.preview(tidy, 1, "t").collect()] == [2]
    assert [(str(r["date"]), r["value"]) for r in clean.dated_history(tidy, "a").orderBy("date").collect()] == [("2024-01-01", 1.0), ("2024-01-02", 5.0)]
    assert clean.lost_dates(demo_orders(spark)).first()["lost"] == 1


def test_files(spark, tmp_path):
    df = demo_orders(spark)
    for kind in (" CSV ", "json", "Parquet"):
        path = write_table(df, f"{tmp_path}/t", kind)
        assert path.endswith(kind.strip().lower())
        assert sorted(map(str, read_table(spark, path, kind, df.schema).select(*df.columns).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="csv, parquet, json"):
        write_table(df, f"{tmp_path}/t", "xlsx")
    (tmp_path / "a.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    assert read_json(spark, f"{tmp_path}/a.json").count() == 2
    (tmp_path / "in.csv").write_text("k,v\n1,$2\n2,x\n")
    assert run_recipe(spark, f"{tmp_path}/in.csv", to_json([Step("number_or_drop", {"column": "v"})]), f"{tmp_path}/out").count() == 1
    assert read_table(spark, f"{tmp_path}/out.csv", "csv").first()["v"] == 2.0
