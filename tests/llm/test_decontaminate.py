import random

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import brute_force, decontaminate, op8_decontaminate


def rows(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), (F.col("n_hit") > 0)).collect()}


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "Cé", "d1", "ñ", "x" * 30]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([12, 10, 9, 3, 1, 30, 0, 11])] + [(98, None), (99, "zz yy " * 6)]
    docs = [(i, rng.choice(["", "- "]) + say(rng.randrange(60)) + rng.choice(["", " | " + rng.choice(items[:6])[1].upper() + ", " + say(5)])) for i in range(120)] + [(500, None), (501, ""), (502, "a " * 3000), (503, "zz yy " * 2000)]
    got = rows(decontaminate(spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")))
    assert got == {i: brute_force(t, items) for i, t in docs}


def test_without_a_look_up_first_it_is_the_same(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(str(rng.randrange(40)) for _ in range(n))
    items = [(i, say(20)) for i in range(12)]
    docs = [(i, say(8) + " " + items[i % 12][1] + " " + items[(i * 5) % 12][1]) for i in range(40)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate(a, b, checked_prints=-1)) == {i: brute_force(t, items) for i, t in docs}


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r)[1:] for r in op8_decontaminate(spark, sf).collect()}
    want = {i: brute_force(t, items) for i, t in docs}
    assert got == want and any(w[1] for w in want.values())


def test_repeated_words_take_no_pairs(spark):
    docs = [(1, "tide " * 20_000), (2, "tide " * 9), (3, "low " + "tide " * 10)]
    got = rows(decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a", "tide " * 500), ("b", "tide " * 400)], "item_id string, text string")))
    assert {i: r[:3] for i, r in got.items()} == {1: (20_000, 20_000, 2), 2: (9, 0, 0), 3: (11, 10, 2)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate(docs, items)) == {}
    assert rows(decontaminate(spark.createDataFrame([Row(doc_id=1, text="a b")]), items))[1][:3] == (2, 0, 0)
