import random
import re

import numpy as np

import corpus_pipeline
from tidemark.llm import repeats
from tidemark.llm.repeats import SPAN, remove_repeats


def cut(texts, words=51):
    """Kept bytes of each text, by counting all windows of SPAN bytes and of `words` words."""
    raw, seen = [(t or "").encode() for t in texts], {}
    bounds = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", data)] for data in raw]

    def windows(data, at):
        for k in range(len(data) - SPAN + 1):
            yield data[k : k + SPAN], k, k + SPAN
        for k in range(len(at) - words + 1):
            yield tuple(data[a:b] for a, b in at[k : k + words]), at[k][0], at[k + words - 1][1]

    for pair in zip(raw, bounds):
        for window, _, _ in windows(*pair):
            seen[window] = seen.get(window, 0) + 1
    out = []
    for data, at in zip(raw, bounds):
        gone = np.zeros(len(data), bool)
        for window, a, b in windows(data, at):
            if seen[window] > 1:
                gone[a:b] = True
        out.append(bytes(b for b, g in zip(data, gone) if not g))
    return out


def made(seed):
    rng = random.Random(seed)
    say = lambda n, most=5: "".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, most))) + rng.choice("  \n") for _ in range(n))
    shared = [say(n) for n in (50, 51, 52, 70, 200)] + [say(40, 30)]
    out = [say(rng.randrange(60)) + rng.choice(shared) + say(rng.randrange(60)) + rng.choice(shared)[: rng.randrange(1, 600)] for _ in range(60)]
    return out + [out[0], shared[1].replace("\n", "\t "), "a " * 50, "a " * 51, "a " * 52, None, "", say(51).strip()]


def test_words_and_bytes_against_all_windows(spark):
    texts = made(1)
    got = {r["row"]: bytes(r["kept_bytes"]) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), words=51).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts)


def test_small_limits_give_the_same(spark, monkeypatch):
    for name, value in (("LIMIT", 2), ("CHUNK", 1500), ("SEGMENT", 700)):
        monkeypatch.setattr(repeats, name, value)
    texts = made(2)
    got = {r["row"]: bytes(r["kept_bytes"]) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "row long, text string"), words=51).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts)


def test_stage_cuts_short_passages_of_51_words(spark):
    words = [f"w{k}" for k in range(51)]
    texts = ["one " + " ".join(words) + " two", "three " + " ".join(words) + " four", "five " + " ".join(words[:50]) + " six"]
    assert len(" ".join(words)) < 210
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert got == {0: "one  two", 1: "three  four", 2: texts[2]}
