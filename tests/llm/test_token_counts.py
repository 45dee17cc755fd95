import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.token_counts import PrefixCounter, count_tokens, longest_prefix, op9_token_counts, prefix_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return PrefixCounter(PATH), Tokenizer.from_file(PATH)


SAMPLES = ["", " ", "  ", "a", "Hello world", "don't we'll they've 're 'rest ''s !!'s", "a  b\n\n c\t\td  ", "x\n \n  y", "été ça va où", "中文 テキスト 🙂🙂 ﬁ", "1234 5678.90", " " * 300 + "x", "=" * 500, "a" * 700, "<|endoftext|>", "foo!<|endoftext|> bar<|endoftext|><|endoftext|>", "\x1c\x1d a\x85b​c﻿", "a \x1f b", "'", "'l", " 's", "é" * 90]


@pytest.mark.parametrize("text", SAMPLES)
def test_every_prefix(both, text):
    mine, library = both
    counts = prefix_counts(mine.changes(text))
    assert len(counts) == len(text) + 1
    step = max(1, len(text) // 120)
    for i in [*range(0, len(text) + 1, step), len(text)]:
        assert counts[i] == len(library.encode(text[:i], add_special_tokens=False).ids), i


def test_random_texts(both):
    mine, library = both
    rng = random.Random(7)
    letters = "aab etnsr  \n\t'.,!-_0129éßñ中🙂 <|>"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        counts = prefix_counts(mine.changes(text))
        for i in range(len(text) + 1):
            assert counts[i] == len(library.encode(text[:i], add_special_tokens=False).ids), (text, i)


def test_budget(both):
    mine, library = both
    text = "The quick brown fox jumps over the lazy dog. " * 30
    n = longest_prefix(mine.changes(text), 50)
    assert len(library.encode(text[:n]).ids) <= 50 < len(library.encode(text[: n + 1]).ids)
    assert mine.changes(None) == b"" and np.array_equal(prefix_counts(b""), [0])


def test_query_against_the_library(spark):
    library = Tokenizer.from_file(PATH)
    want = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op9_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = want(texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 512)
        assert want(texts[r["doc_id"]][: r["budget_chars"]]) <= 512


def test_odd_rows_through_spark(spark):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "<|endoftext|>", "a<|endoftext|> b", "word " * 4000, "é中🙂" * 300, "a", "a"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id")], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "'x' as token_changes", "2 as __text")
    rows = count_tokens(df, PATH).collect()
    assert sorted(rows[0].asDict()) == ["__text", "budget_chars", "doc_id", "n_tokens", "text", "token_changes"] and len(rows) == len(texts) + 1
    for r in rows:
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert len(prefix_counts(bytes(r["token_changes"]))) == len(r["text"] or "") + 1
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_vocabularies_that_are_not_followed_are_refused(tmp_path):
    import json

    with pytest.raises(ValueError, match="normalizer"):
        PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}, {"added_tokens": [{"content": "x", "special": False}]}, {"model": spec["model"] | {"vocab": {"a" * 129: 1}}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            PrefixCounter(str(tmp_path / "v.json"))
