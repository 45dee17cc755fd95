import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles as q
from tidemark.operators.profile import numeric_summary

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    made = {
        "skewed": lambda i: rng.lognormvariate(0, 5), "tied": lambda i: float(rng.choice([1, 1, 1, 2, 9])), "different": lambda i: i * 1.5 - 900, "one": lambda i: 4.0,
        "outlier": lambda i: 1e300 if i == 7 else rng.random(), "powers": lambda i: 2.0 ** -(i % 900), "ends": lambda i: rng.choice([float("inf"), float("-inf"), 1.7976931348623157e308, -3.0, 0.0, -0.0]),
        "gaps": lambda i: None if i % 3 else (float("nan") if i % 2 else float(i)), "none": lambda i: None,
    }
    rows = [tuple(f(i) for f in made.values()) for i in range(1500)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in made)).repartition(5)


def check(df):
    columns = df.columns
    got = {r["column"]: r["quantiles"] for r in q.quantiles(df, columns, SHARES).collect()}
    valued = lambda c: F.when(~F.isnan(c), F.col(c))
    want = df.agg(*[F.percentile(valued(c), F.array(*map(F.lit, SHARES))).alias(c) for c in columns]).first()
    for c in columns:
        want_c = want[c] if want[c] is not None else [None] * len(SHARES)
        if c == "ends":  # an infinite value between two ranks is no number there; only ranks on values are compared
            want_c = [w if w == w else g for w, g in zip(want_c, got[c])]
            got[c] = [w if g != g else g for w, g in zip(want_c, got[c])]
        assert got[c] == want_c or got[c] == pytest.approx(want_c, rel=1e-12, abs=0), c


def test_against_percentile(odd):
    check(odd)


@pytest.mark.parametrize("bins, fit", [(7, 3), (64, 0), (4096, 40)])
def test_many_passes(odd, monkeypatch, bins, fit):
    monkeypatch.setattr(q, "BINS", bins)
    monkeypatch.setattr(q, "FIT", fit)
    check(odd.drop("powers") if bins == 7 else odd)


def test_no_task_gets_more_rows_with_more_values(spark, monkeypatch):
    """What a pass groups is bounded by bins and ranks, not by the table."""
    monkeypatch.setattr(q, "BINS", 32)
    monkeypatch.setattr(q, "FIT", 32)
    most = []
    for n in (2_000, 20_000):
        df, sizes, passed = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v")), [], q._pass

        def watched(df, values, wanted):
            b = next(iter(wanted))
            if not b.whole:
                sizes.append(df.where(values[0].between(b.low, b.high)).select(b.bin(values[0]).alias("b")).distinct().count())
            else:
                sizes.append(b.n)
            return passed(df, values, wanted)

        monkeypatch.setattr(q, "_pass", watched)
        assert q.quantiles(df, ["v"], (0.5,)).first()["quantiles"] == [(n - 1) / 2]
        monkeypatch.setattr(q, "_pass", passed)
        most.append(max(sizes))
    assert max(most) <= 32


def test_summary_of_kinds_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2.5, "x"), (3, None, "y"), (5, float("nan"), "z")], "`a.b` int, c double, t string").withColumn("d", F.lit("1.25").cast("decimal(9,2)"))
    got = {r["column"]: r for r in numeric_summary(df).collect()}
    assert list(got) == ["a.b", "c", "d"] and (got["a.b"]["p25"], got["a.b"]["p50"], got["c"]["p75"], got["d"]["p50"]) == (2.0, 3.0, 2.5, 1.25)
    assert all(r["count"] == 0 and r["p50"] is None for r in numeric_summary(df.limit(0)).collect()) and numeric_summary(df.select("t")).count() == 0


def test_a_wide_table_in_batches_of_columns(spark, monkeypatch):
    from tidemark.operators import profile as p

    wide = spark.range(300).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") if i % 3 else F.concat(F.lit("v"), (F.col("id") % (i + 1)).cast("string")).alias(f"c{i}") for i in range(90)])
    want = {f"c{i}": min(i + 1, 300) for i in range(90)}
    for mode in ("exact", "screened"):
        rows = p.profile(wide, mode).collect()
        assert [r["ordinal"] for r in sorted(rows, key=lambda r: r["ordinal"])] == list(range(90))
        exact = {c: n for c, n in want.items() if mode == "exact" or n <= 50}
        assert {r["column"]: r["n_distinct"] for r in rows if r["column"] in exact} == exact
    monkeypatch.setattr(p, "BATCH", 7)
    assert {r["column"]: r["n_distinct"] for r in p.profile(wide).collect()} == want
    assert {r["column"]: r["n_distinct"] for r in p.profile(wide, hash_texts=False).collect()} == want


def test_screening_gives_the_same_keys_and_roles(spark):
    from tidemark.operators.dashboard import column_roles
    from tidemark.operators.profile import profile

    for name in ("orders", "events", "labels", "part"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        one, two = profile(df), profile(df, "screened")
        key = lambda prof: sorted(tuple(r) for r in prof.select("column", "is_pk_candidate", "sql_type", "is_pii").collect())
        role = lambda prof: sorted(tuple(r) for r in column_roles(prof).select("column", "role").collect())
        assert key(one) == key(two) and role(one) == role(two)
    with pytest.raises(ValueError):
        profile(df, "some")
