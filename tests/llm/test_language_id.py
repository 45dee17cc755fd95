import math
import random
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.language_id import LanguageModel, count_grams, grams, identify, op4_language_id, train


def test_grams_of_texts():
    key, bounds = grams(["Ab, c!", "", "é"])
    show = lambda k: [int(k) >> s & 0xFFFF for s in (48, 32, 16, 0)]
    assert [show(k) for k in key] == [[1, 1, 1, 97], [1, 1, 97, 98], [1, 97, 98, 32], [97, 98, 32, 99], [98, 32, 99, 32], [1, 1, 1, 233]]
    assert bounds.tolist() == [0, 5, 5, 6]


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    counts = {}
    for name, letters in (("x", "abcde "), ("y", "cdefg ")):
        key, _ = grams(["".join(rng.choice(letters) for _ in range(400)) for _ in range(3)])
        counts[name] = np.unique(key, return_counts=True)
    model = LanguageModel(counts)
    for context in ("abc", "bca", "zzz", " a "):
        h = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        keys = np.arange(65536, dtype=np.uint64) | np.uint64(h)
        total = np.exp(model._log_prob(keys, 4).astype(np.float64)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-3), (context, total)


def test_kneser_ney_by_hand():
    """One language, one text: the four-gram probability follows the recursion written out with dictionaries."""
    text = "abcabdabcab"
    key, _ = grams([text])
    keys, n = np.unique(key, return_counts=True)
    model = LanguageModel({"x": (keys, n)})
    level = {4: {tuple(int(k) >> s & 0xFFFF for s in (48, 32, 16, 0)): int(c) for k, c in zip(keys, n)}}
    for m in (3, 2, 1):
        level[m] = {}
        for g in level[m + 1]:
            level[m][g[1:]] = level[m].get(g[1:], 0) + 1

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / 65536
        own = level[m]
        n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.05
        same = [v for k, v in own.items() if k[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(own.get(g, d) - d, 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])

    for g in list(level[4]) + [(97, 98, 99, 120), (1, 1, 1, 98), (120, 98, 99, 97)]:
        k = np.array([sum(c << s for c, s in zip(g, (48, 32, 16, 0)))], np.uint64)
        assert math.isclose(math.exp(model._log_prob(k, 4)[0, 0]), p(g), rel_tol=1e-4), g


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op4_language_id(spark, sf).collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(truth)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in truth)
    held = [(i, lang) for i, lang, _ in truth if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nulls_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    odd = [(1, None), (2, ""), (3, "12 !?"), (4, "xqzj kvwp zzkq wxyq jjqk " * 40), (5, "The and of that")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert got[4]["rejected"] and not got[5]["rejected"] and got[5]["lang_pred"] == "en"
    assert identify(docs, model).where("rejected").count() == 0
    assert train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert [r["lang_pred"] for r in identify(docs.limit(2), None).collect()] == ["und"] * 2
    assert count_grams(docs.limit(0), "text", "lang").count() == 0
