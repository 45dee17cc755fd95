import pytest
from pyspark.sql import functions as F

from tidemark.operators.health import index_hints
from tidemark.operators.profile import profile
from tidemark.sources.layout import Layout, exchanges, files_between, files_read, layout_of, read_dates, read_keys, write_buckets, write_laid_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def test_hints_become_a_layout(events):
    found = layout_of(events, index_hints(profile(events)))
    assert (found.date, found.key, found.bucket, found.files) == ("ts", "event_id", "user_id", 1)
    assert layout_of(events, index_hints(profile(events)), max_parts=3).grain in ("month", "year")
    assert layout_of(events, index_hints(profile(events)), file_bytes=1_000).files > 3
    assert layout_of(events.select("value"), index_hints(profile(events.select("value")))) == Layout(None, "day", None, None, 1)


@pytest.mark.parametrize("grain", ["day", "month", "year"])
def test_a_range_of_dates_reads_only_its_partitions(spark, events, tmp_path, grain):
    layout = Layout("ts", grain, None, None, 4)
    odd = events.unionByName(events.limit(3).withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType)))
    path = write_laid_out(odd, f"{tmp_path}/t", layout)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    low, high = str(first.date()), str((first + (last - first) / 10).date())
    got = read_dates(spark, path, layout, low, high)
    assert got.columns == events.columns
    want = events.where(f"ts >= '{low}' and ts < '{high}'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    parts = spark.read.parquet(path).select(layout.part).distinct().count()
    if grain != "year":
        assert 0 < files_read(got)[1] < parts
    assert spark.read.parquet(path).count() == odd.count()


def test_a_range_of_keys_reads_only_its_files(spark, events, tmp_path):
    layout = Layout(None, "day", "event_id", None, 6)
    path = write_laid_out(events.repartition(5), f"{tmp_path}/t", layout)
    n = events.count()
    got = read_keys(spark, path, layout, 10, n // 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.where(f"event_id between 10 and {n // 10}").collect()))
    assert files_read(got)[0] == len(files_between(spark, path, 10, n // 10)) == 1
    assert read_keys(spark, path, layout, -9, -1).count() == 0 and spark.read.parquet(path).count() == n


def test_dates_and_keys_together(spark, events, tmp_path):
    layout = Layout("ts", "month", "event_id", None, 8)
    path = write_laid_out(events, f"{tmp_path}/t", layout)
    got = read_keys(spark, path, layout, 100, 120)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.where("event_id between 100 and 120").collect()))


def test_joins_of_buckets_do_not_shuffle(spark, tmp_path):
    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = write_buckets(orders, f"{tmp_path}/o", "o_orderkey", 4), write_buckets(lines, f"{tmp_path}/l", "l_orderkey", 4)
        joined = b.join(a, b["l_orderkey"] == a["o_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("n"))
        plain = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("n"))
        assert exchanges(joined) == 0 < exchanges(plain)
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_empty_table(spark, events, tmp_path):
    layout = Layout("ts", "day", "event_id", None, 2)
    path = write_laid_out(events.limit(0), f"{tmp_path}/t", layout)
    assert read_keys(spark, path, layout, 0, 9).count() == 0


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    from tests.oracle import compare
    from tidemark.catalog import cleaning
    from tidemark.sources import layout

    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    n, width = lines.count(), int(lines._jdf.schema().defaultSize())
    assert layout.n_buckets(lines) == 8
    monkeypatch.setattr(layout, "BUCKET_BYTES", n * width // 30)
    assert layout.n_buckets(lines.limit(1), lines) in (30, 31) and layout.n_buckets(lines.limit(1)) == 8
    function, sql = cleaning.ENTRIES["layout_bucketed_join"]
    assert len([f for f in function(spark, SF).inputFiles() if "/lines/" in f]) in (30, 31)
    compare(spark, SF, function, sql)
