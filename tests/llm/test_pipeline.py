import re

import duckdb
import numpy as np

import corpus_pipeline
from corpus_pipeline import STAGES
from tests.llm.test_passages import cut
from tidemark.llm import decontaminate, near_copies, pieces


def one_of_near(texts):
    ids = sorted(texts)
    first = near_copies.brute_force([texts[i] for i in ids])
    return {i: texts[i] for k, i in enumerate(ids) if first[k] == k}


def without_passages(texts):
    ids, out = list(texts), {}
    for i, kept in zip(ids, cut([texts[i] for i in ids])):
        whole = kept == (texts[i] or "").encode()
        if whole or kept.decode(errors="ignore").strip(" "):
            out[i] = texts[i] if whole else kept.decode(errors="ignore")
    return out


def clean(texts, items):
    n_words = lambda t: len(re.findall(decontaminate.WORD, t or ""))
    long = [(i, t) for i, t in items if n_words(t) >= decontaminate.SPAN]

    def stays(t):
        n, hit = decontaminate.brute_force(t, items)[:2]
        return not (decontaminate.brute_force(t, long)[1] or (hit and 2 * hit >= n))

    return {i: t for i, t in texts.items() if stays(t)}


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (name, stage), want in zip(STAGES, (lambda t: {i: x for i, x in t.items() if any(map(str.isalpha, x or ""))}, one_of_near, without_passages, lambda t: clean(t, items))):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        texts = want(texts)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == texts, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    rows = STAGES[4][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(r["round_trip"] for r in rows)
    vocabulary = pieces.vocabulary_of(corpus_pipeline.public_tokenizers.path(corpus_pipeline.MODEL))
    assert all(vocabulary.decode(np.array(r["ids"]))[1:].decode() == (texts[r["doc_id"]] or "") for r in rows if r["ids"])


def test_odd_columns_nulls_and_empty(spark):
    rows = [(None, "The and of that", "en"), (1, None, "en"), (2, "", None), (3, "The of and this is that", "en"), (3, "The of and this is that", "en"), (4, "Of the and " * 90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n_hit", "2 as fp", "'z' as removed_spans", "7 as rejected")
    for some in (docs, docs.limit(0)):
        for _, stage in STAGES[:-1]:
            some = stage(spark, some, "/root/testdata/sf0.001")
            assert some.columns == docs.columns
            some = spark.createDataFrame(some.collect(), docs.schema)
        out = STAGES[-1][1](spark, some, "/root/testdata/sf0.001").collect()
        assert {r["doc_id"] for r in out} in ({None, 3}, set())  # 4 repeats itself throughout
