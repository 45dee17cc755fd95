import pytest
from pyspark.sql import functions as F

from tidemark.operators.dashboard import column_roles
from tidemark.operators.profile import profile
from tidemark.operators.requests import answers, confirmation, resolve, validate_json


@pytest.fixture(scope="module")
def frames(spark):
    frame = spark.createDataFrame([(i, r, 10.0 * i) for i, r in enumerate(["west", "east", "north"] * 3, 1)], "order_id long, region string, amount double")
    sales = spark.createDataFrame([(i, r, 100.0 * i) for i, r in enumerate(["north", "south", "east"] * 3, 1)], "order_id long, store string, revenue double")
    multi = frame.withColumn("category", F.element_at(F.array(*map(F.lit, "abc")), ((F.col("order_id") - 1) % 3 + 1).cast("int")))
    time = spark.range(120).select((F.col("id") % 3 + 1).alias("Store"), (F.lit("2010-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("Date"), (F.lit(1000.0) + F.col("id")).alias("Weekly_Sales"), (F.lit(20) + F.col("id") % 30).cast("double").alias("Temperature"))
    out = {"FRAME": frame, "SALES": sales, "MULTI": multi, "TIME": time}
    return {k: (df, column_roles(profile(df)).cache()) for k, df in out.items()}


#: Messages and what they must resolve to.
CASES = [
    ("top 5 amount by region as pie chart", "FRAME", dict(resolved="chart", chart_type="pie", dimension="region", measure="amount", agg="sum", top_n=5)),
    ("amount by region", "FRAME", dict(resolved="chart", chart_type="bar", dimension="region", measure="amount")),
    ("region", "FRAME", dict(resolved="chart", dimension="region", measure=None, agg="count")),
    ("top 3 regions", "FRAME", dict(measure="amount", agg="sum", top_n=3)),
    ("average amount by region", "FRAME", dict(agg="mean", measure="amount")),
    ("order by top sellers selling the most", "SALES", dict(dimension="store", measure="revenue", agg="sum", top_n=10)),
    ("which shops are selling the most", "SALES", dict(dimension="store", measure="revenue")),
    ("top 2 amount by region as bar chart", "FRAME", dict(chart_type="bar", dimension="region", measure="amount", agg="sum", top_n=2)),
    ("quiero ver las ventas totales semanales", "TIME", dict(chart_type="line", dimension="Date", measure="Weekly_Sales", agg="sum", grain="week")),
    ("las mayores ventas mensuales", "TIME", dict(chart_type="line", dimension="Date", top_n=None, grain="month")),
    ("ventas mensuales en barras", "TIME", dict(chart_type="bar", grain="month")),
    ("ventas por tienda", "TIME", dict(dimension="Store", measure="Weekly_Sales", grain=None)),
    ("promedio de temperatura por tienda", "TIME", dict(dimension="Store", measure="Temperature", agg="mean", grain=None)),
    ("ventas semanales por tienda", "TIME", dict(dimension="Store", grain=None)),
    ("top 3 stores by temperature as bar chart", "TIME", dict(dimension="Store", measure="Temperature", top_n=3)),
    ("quiero un gráfico de amount por region", "FRAME", dict(resolved="chart", dimension="region", measure="amount")),
    ("what is the total amount", "FRAME", dict(resolved="scalar", measure="amount", agg="sum")),
    ("cuánto es el total de amount", "FRAME", dict(resolved="scalar", measure="amount")),
    ("what is the average amount", "FRAME", dict(resolved="scalar", agg="mean")),
    ("amount by region no graph", "FRAME", dict(resolved="answer", dimension="region")),
    ("what about widgets", "MULTI", dict(resolved="none")),
    ("quiero ver los helicopteros", "TIME", dict(resolved="none", dimension=None)),
    ("", "FRAME", dict(resolved="none")),
    (None, "FRAME", dict(resolved="none")),
]


def test_messages(spark, frames):
    for name, (_, catalog) in frames.items():
        own = [(i, m, w) for i, (m, f, w) in enumerate(CASES) if f == name]
        rows = {r["msg_id"]: r for r in resolve(spark.createDataFrame([o[:2] for o in own], "msg_id long, text string"), catalog).collect()}
        assert len(rows) == len(own)
        for i, message, want in own:
            assert {k: rows[i][k] for k in want} == want, message


def test_proposals(spark, frames):
    texts = [
        '```json\n{"dimension":"category","measure":"amount","chart_type":"pie","agg":"sum","top_n":3}\n```', '{"dimension":"supplier","measure":"amount"}',
        '{"dimension":"category","measure":"profit_margin"}', '{"dimension": null}', "no braces", None, '{"dimension":"category","measure":"amount","agg":"median","top_n":99,"grain":"week","chart_type":"donut"}',
    ]
    rows = validate_json(spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string"), frames["MULTI"][1]).orderBy("msg_id").collect()
    got = [tuple(r)[1:] for r in rows]
    none = (False, None, None, None, None, None, None)
    assert got == [(True, "pie", "category", "amount", "sum", 3, None), none, (True, "bar", "category", None, "count", None, None), none, none, none, (True, "bar", "category", "amount", "sum", None, None)]


def test_answers_and_confirmation(spark, frames):
    df, catalog = frames["FRAME"]
    found = resolve(spark.createDataFrame([(1, "top 2 regions"), (2, "top 2 regions"), (3, "hm")], "msg_id long, text string"), catalog)
    got = sorted(tuple(r) for r in answers(df, found).collect())
    assert got == [(1, "east", 150.0), (1, "north", 180.0), (2, "east", 150.0), (2, "north", 180.0)]
    said = {r["msg_id"]: r["confirmation"] for r in confirmation(found).collect()}
    assert said[1] == "Added: total **amount** by top 2 **region**, as a **bar** chart." and said[3] is None


def test_mentions_meet_by_keys_as_all_pairs_do(spark):
    import difflib
    import random
    import re

    from tidemark.operators.requests import SIMILAR, mentions

    rng = random.Random(4)
    syllables = ["re", "ve", "nue", "a", "mount", "store", "_", "total", "x", "id", "sales", "ó"]
    names = list(dict.fromkeys("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(60)))
    bend = lambda n: n if rng.random() < 0.4 else n[: rng.randrange(len(n))] + rng.choice("abst") + n[rng.randrange(len(n)) :]
    texts = [" ".join(bend(rng.choice(names)) for _ in range(rng.randrange(6))) for _ in range(80)] + [None, "", "a", "ab"]
    catalog = spark.createDataFrame([(n, "measure", i) for i, n in enumerate(names)], "column string, role string, ordinal int")
    found = mentions(spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string"), catalog)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    plain = lambda s: s.lower().replace("ó", "o")
    want = set()
    for i, text in enumerate(texts):
        t = plain((text or "").strip())
        words = re.findall("[a-z0-9_]+", t)
        for n in names:
            needle = plain(n)
            inside = [w for w in words if len(w) >= 3 and (w in needle or needle in w)]
            near = [w for w in words if len(w) >= 4 and difflib.SequenceMatcher(None, w, needle).ratio() >= SIMILAR]
            if needle in t:
                want.add((i, n, t.index(needle) + 1))
            elif inside or near:
                want.add((i, n, t.index((inside or near)[0]) + 1))
    assert {(r["msg_id"], r["column"], r["at"]) for r in found.collect()} == want


def test_all_answers_of_a_log_come_from_one_read(spark, frames, tmp_path):
    from tidemark.operators.charts import ChartRequest, chart_query, charts

    frames["TIME"][0].withColumn("flag", F.col("Store") > 1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    asked = [ChartRequest("Store", "Weekly_Sales", "sum", "bar", 2), ChartRequest("Date", "Weekly_Sales", "mean", "line", grain="month"), ChartRequest("Date", None, "count", "bar", 1, "year"), ChartRequest("Date", "Temperature", "sum", "line", grain="week"), ChartRequest("flag", "Temperature", "mean", "pie"), ChartRequest("Store", "Weekly_Sales", "sum", "line")]
    out = charts(df, asked)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = sorted(map(tuple, out.collect()))
    want = [(i, k, str(r["x"]).lower() if isinstance(r["x"], bool) else str(r["x"]), float(r["value"])) for i, a in enumerate(asked) for k, r in enumerate(chart_query(df, a).collect(), 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert charts(df, []).count() == 0


def test_repeated_rows_under_forced_equal_hashes(spark):
    from tidemark.operators.health import duplicate_rows

    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (2, None), (3, "c")], "i int, t string")
    for one_hash in (lambda *c: F.lit(7), lambda *c: F.pmod(F.xxhash64(*c), F.lit(2)), F.xxhash64):
        assert duplicate_rows(df, hash_of=one_hash).first()["duplicates"] == 2


#: Messages with marks, other letters, other gaps and nothing at all.
ODD = ["einßbest üung", "a best chart", "no-graph please", "what, is the total", "what's up", "what s up", "cúanto es", "GRÁFICO", "Åreas TOP 5", "ẗop 7", "top\u000b5", "top 6", "xtop 5", "top 123", "top 12ñ", "taİlİsman lİne", "Ṗie", "per_week", "per - week", "日best本", None, "", "́", "over\ntime"]


@pytest.mark.parametrize("name", ["tag_intents", "tag_synonyms"])
def test_odd_messages_give_the_rows_of_their_sql(spark, tmp_path, name):
    from tests.oracle import compare
    from tidemark.catalog import messages

    said = [(i, 0, "user", t) for i, t in enumerate([*ODD, "státus", "ßstate", "eśtado", "status-bar"])]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet/")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet/")
    function, sql = messages.ENTRIES[name]
    for t in ("conversations", "orders"):  # the SQL reads files
        folder = tmp_path / f"{t}.parquet"
        part = next(folder.glob("part-*.parquet"))
        part.rename(tmp_path / f"{t}_part")
        for f in (*folder.iterdir(),):
            f.unlink()
        folder.rmdir()
        (tmp_path / f"{t}_part").rename(folder)
    compare(spark, str(tmp_path), function, sql)


def test_mentions_read_texts_once_a_way_and_join_no_text(spark, monkeypatch):
    from tidemark.operators import requests

    catalog = spark.createDataFrame([("amount", "measure", 0), ("ab", "dimension", 1), ("store_id", "dimension", 2)], "column string, role string, ordinal int")
    log = spark.createDataFrame([(1, "the store 👍 amount"), (2, "amuont of x"), (3, "ab"), (4, None), (5, "stores tor amounts amounts")], "msg_id long, text string")
    found = requests.mentions(log, catalog)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "lambda" not in plan
    got = sorted((r["msg_id"], r["column"], r["at"]) for r in found.collect())
    assert (1, "amount", 13) in got and (1, "store_id", 5) in got and (3, "ab", 1) in got and not [g for g in got if g[0] == 4]
    monkeypatch.setattr(requests, "MAX_WORDS", 0)
    assert sorted((r["msg_id"], r["column"], r["at"]) for r in requests.mentions(log, catalog).collect()) == got
