import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic
from tidemark.llm.periodic import brute_force, brute_row, op12_periodic, periodic_runs, runs_of, words_of

SF = "/root/testdata/sf0.001"


def own(lists):
    """The runs of each list of words, all lists as one slice."""
    code = np.unique(np.array([w for x in lists for w in x], dtype=np.int64), return_inverse=True)[1] if any(lists) else np.empty(0, np.int64)
    offsets = np.cumsum([0, *map(len, lists)])
    runs, text = runs_of(code, offsets)
    return [[tuple(r) for r in runs[text == i].tolist()] for i in range(len(lists))]


def made(rng, letters, n):
    """Words of few letters with planted repetitions, some inside others."""
    out = []
    while len(out) < n:
        part = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        out += part * rng.choice([1, 1, 2, 3, 12]) + part[: rng.randrange(len(part))]
        if rng.random() < 0.2:
            out += out[-rng.randrange(1, 90) :]
    return out[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 40, 1000])
def test_made_texts(letters):
    rng = random.Random(letters)
    lists = [made(rng, letters, rng.choice([0, 1, 11, 12, 13, 60, 250])) for _ in range(60)]
    assert own(lists) == [brute_force(x)[0] for x in lists]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_any_texts(lists):
    assert own(lists) == [brute_force(x)[0] for x in lists]


def test_special_words():
    fibonacci, other = [0], [0, 1]
    while len(other) < 500:
        fibonacci, other = other, other + fibonacci
    thue = [bin(i).count("1") % 2 for i in range(512)]
    lists = [other, thue, thue + thue, [7] * 400, [0] * 100 + [1] + [0] * 100 + [2] + [0] * 50]
    assert own(lists) == [brute_force(x)[0] for x in lists]


def test_lags_in_small_blocks_and_few_rounds_give_the_same(monkeypatch):
    rng = random.Random(5)
    lists = [made(rng, 3, 400) for _ in range(5)]
    want = own(lists)
    monkeypatch.setattr(periodic, "BLOCK", 4)
    monkeypatch.setattr(periodic, "ROUNDS", 1)
    assert own(lists) == want


def test_a_very_long_text():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 50, 60_001)
    code = np.concatenate([rng.integers(0, 50, 40_000), part, part, part[:9], rng.integers(0, 50, 30_000)])
    runs = [r for r in own([code.tolist()])[0] if r[2] > 100]
    assert len(runs) == 1 and runs[0][2] == 60_001 and runs[0][1] >= 2 * 60_001 + 9


def test_words():
    words, offsets = words_of(pa.array(["  a\tb\x0bc\x0cd\re\nf\x1cg\x85h　i  ", None, "", " x "]).slice(0))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f\x1cg\x85h　i", "x"] and offsets.tolist() == [0, 6, 6, 6, 7]
    words, offsets = words_of(pa.array(["no", "x y", "z"]).slice(1))
    assert words.to_pylist() == ["x", "y", "z"] and offsets.tolist() == [0, 2, 3]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r.asDict() for r in op12_periodic(spark, SF).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len((r["text"] or "").split()) < 1500]
    assert len(short) > 0.9 * len(docs) and sum(r["n_runs"] > 0 for r in got.values()) > 10
    for r in short:
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \t ", "a " * 12, "a " * 11, "x y " * 6, "x y " * 6, "one " + "p q r s " * 5 + "two", "ü é　 " * 30]
    rows = [(i, t, i, "k") for i, t in enumerate(texts)] + [(None, "a " * 40, 1, None), (3, "b " * 40, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, collapsed_text string").selectExpr("*", "1 as Runs", "2 as __text")
    out = periodic_runs(docs).collect()
    assert len(out) == len(rows) and sorted(out[0].asDict()) == ["__text", "collapsed_text", "doc_id", "n_words", "runs", "text"]
    for r in out:
        runs, kept = brute_force([w for w in (r["text"] or "").encode().split()])
        assert [tuple(x) for x in r["runs"]] == runs and r["collapsed_text"].encode() == b" ".join(kept)
    assert periodic_runs(docs.limit(0)).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: repr(sorted(r.items(), key=str))
    assert sorted((r.asDict() for r in op12_periodic(spark, str(tmp_path)).collect()), key=key) == sorted((brute_row(r[0], r[1]) for r in rows), key=key)
