import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id
from tidemark.llm.language_id import JoinedModel, identify, train


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")


def test_scores_by_joins_are_those_of_the_arrays(spark, docs):
    """Across the bound on what every task holds the results stay what they are."""
    arrays, joined = train(docs), train(docs, cells=0)
    assert isinstance(joined, JoinedModel) and joined.langs == arrays.langs and joined.temperature == arrays.temperature
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 !?"), (-4, "xqzj kvwp zzkq wxyq jjqk " * 40), (-4, "The and of that"), (None, "中文 テキスト")], "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(odd).withColumns({"score": F.lit("x"), "row": F.lit(1), "n": F.lit(2)})
    one, two = (sorted(identify(some, m).collect(), key=lambda r: (str(r["doc_id"]), str(r["text"]))) for m in (arrays, joined))
    assert one[0].asDict().keys() == two[0].asDict().keys() and len(one) == len(two) == some.count()
    for a, b in zip(one, two):
        assert (a["doc_id"], a["text"], a["row"], a["lang_pred"], a["rejected"]) == (b["doc_id"], b["text"], b["row"], b["lang_pred"], b["rejected"])
        assert math.isclose(a["score"], b["score"], abs_tol=1e-4) and math.isclose(a["cross_entropy"], b["cross_entropy"], abs_tol=1e-4)
    assert identify(docs.limit(0), joined).count() == 0


def test_a_share_is_always_left_out(spark, docs):
    labelled = docs.where("lang is not null").count()
    assert labelled < 800
    counted = []
    count = language_id.count_grams
    try:
        language_id.count_grams = lambda d, *a: counted.append(d.count()) or count(d, *a)
        train(docs)
    finally:
        language_id.count_grams = count
    assert 0 < counted[0] < labelled
    assert train(docs.limit(1).withColumn("lang", F.lit("en"))).langs == ["en"]


def test_query_against_brute_force(spark):
    """op4's rows by the model written out with dictionaries, of the same counted and left-out texts."""
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", language_id.fold_of().alias("fold")).collect()
    labelled = [r for r in rows if r["fold"] != 2 and r["text"] is not None and r["lang"] is not None]
    share = min(0.5, max(1 / 20, 200 / len(labelled)))
    hashes = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.pmod(F.xxhash64("text"), F.lit(1_000_000)).alias("h")).collect()}
    fold, show = language_id.fold_table(), {}

    def symbols(text):
        out = []
        for c in text:
            x = int(fold[ord(c)])
            if x != 32 or not out or out[-1] != 32:
                out.append(x)
        return [1, 1, 1, *out]

    for r in labelled:
        if hashes[r["doc_id"]] >= int(1e6 * share) + 1:
            s = symbols(r["text"])
            own = show.setdefault(r["lang"], {})
            for i in range(3, len(s)):
                own[tuple(s[i - 3 : i + 1])] = own.get(tuple(s[i - 3 : i + 1]), 0) + 1
    models = {}
    for name, level in show.items():
        levels = {4: level}
        for m in (3, 2, 1):
            levels[m] = {}
            for g in levels[m + 1]:
                levels[m][g[1:]] = levels[m].get(g[1:], 0) + 1
        contexts = {}
        for m, own in levels.items():
            for g, n in own.items():
                total, kinds = contexts.get((m, g[:-1]), (0, 0))
                contexts[m, g[:-1]] = total + n, kinds + 1
        models[name] = levels, contexts, {m: language_id.discount_of(sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())) for m, own in levels.items()}

    def p(name, g):
        if not g:
            return 1 / 65536
        levels, contexts, discount = models[name]
        m = len(g)
        if (m, g[:-1]) not in contexts:
            return p(name, g[1:])
        total, kinds = contexts[m, g[:-1]]
        return max(levels[m].get(g, discount[m]) - discount[m], 0) / total + discount[m] * kinds / total * p(name, g[1:])

    for r in [r for r in rows if r["text"] and any(map(str.isalpha, r["text"]))][:60]:
        s = symbols(r["text"][:2000])
        if len(r["text"]) <= 2000:
            entropy = {name: -sum(math.log(p(name, tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3) for name in models}
            assert got[r["doc_id"]]["lang_pred"] == min(entropy, key=entropy.get)
            assert math.isclose(got[r["doc_id"]]["cross_entropy"], min(entropy.values()), abs_tol=1e-3)
