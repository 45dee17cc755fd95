import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules, state
from tidemark.operators.profile import numeric_summary, profile
from tidemark.operators.state import StateStore, column_state, merged, merged_days

SF = "/root/testdata/sf0.001"
MERGEABLE = ["ordinal", "column", "dtype", "class", "n_rows", "nulls", "null_pct", "sql_type", "is_pii", "date_like", "number_like", "number_seen"]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    return df.withColumns({"when": F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd")), "odd": F.when(F.col("event_id") % 4 == 0, F.lit("nan").cast("double")).when(F.col("event_id") % 5 > 0, F.col("value")), "mail": F.concat("event_type", F.lit("@x.org"))})


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


def parts(df, n):
    return [df.where(F.col("event_id") % n == i) for i in range(n)]


def test_merged_states_are_the_profile_of_all(events):
    for pieces in (parts(events, 2), [*parts(events, 3), events.limit(0)]):
        got = state.profile_of(merged(*map(column_state, pieces)))
        assert rows(got, *MERGEABLE) == rows(profile(events), *MERGEABLE)


def test_merging_is_associative(events):
    a, b, c = map(column_state, parts(events, 3))
    plain = [c for c in a.columns if c not in ("mean", "m2", "distinct", "quantiles")]
    left, right = merged(merged(a, b), c), merged(a, merged(c, b))
    assert rows(left, *plain) == rows(right, *plain)
    for x, y in zip(rows(left, "column", "mean", "m2"), rows(right, "column", "mean", "m2")):
        assert x == y or x[1:] == pytest.approx(y[1:], rel=1e-9)


def test_numbers_and_estimates(events):
    got = {r["column"]: r for r in state.numbers(merged(*map(column_state, parts(events, 4)))).collect()}
    want = {r["column"]: r for r in numeric_summary(events).collect()}
    counts = {r["column"]: r["n_distinct"] for r in profile(events).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        assert got[c]["count"] == w["count"] and got[c]["min"] == w["min"] and got[c]["max"] == w["max"]
        assert (got[c]["mean"], got[c]["std"]) == pytest.approx((w["mean"], w["std"]), rel=1e-9)
        assert got[c]["n_distinct"] == pytest.approx(counts[c], rel=0.05) and w["min"] <= got[c]["p25"] <= got[c]["p50"] <= got[c]["p75"] <= w["max"]


def test_store_and_rules(spark, events, tmp_path):
    store = StateStore(spark, f"{tmp_path}/s")
    one, two = parts(events, 2)
    store.add("one", one)
    store.add("two", two)
    with pytest.raises(Exception, match="(?i)exists"):
        store.add("two", two)
    assert rows(state.profile_of(store.columns()), *MERGEABLE) == rows(profile(events), *MERGEABLE)
    assert rows(state.profile_of(store.columns("two")), *MERGEABLE) == rows(profile(two), *MERGEABLE)
    whole = store.days().where("column = 'ts'").select("day", "n")
    assert rows(rules.drops_of(whole), "day", "n", "usual", "broken") == rows(rules.volume_drops(events, "ts"), "day", "n", "usual", "broken")
    assert state.freshness(store.columns(), "ts", "2025-01-01 00:00:00").collect() == rules.freshness(events, "ts", "2025-01-01 00:00:00").collect()
    broken = rules.null_rate(state.null_rates(store.columns("one")), state.null_rates(store.columns("two")))
    assert rows(broken, "column", "broken") == rows(rules.null_rate(profile(one), profile(two)), "column", "broken")
    limits = state.outlier_limits(store.columns("one"))
    far = two.withColumn("value", F.when(F.col("event_id") % 100 == 1, 1e9).otherwise(F.col("value")))
    assert state.outside(far, limits, ["value", "odd"]).where("outlier_columns like '%value%'").count() >= far.where("value = 1e9").count() > 0


def test_columns_that_come_and_go(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([(2.5, None)], "i double, u string")
    got = {(r["column"], r["dtype"]): r for r in merged(column_state(a), column_state(b)).collect()}
    assert set(got) == {("i", "int"), ("t", "string"), ("i", "double"), ("u", "string")} and got["u", "string"]["nulls"] == 1
    assert merged_days(state.day_state(a), state.day_state(b)).count() == 0
