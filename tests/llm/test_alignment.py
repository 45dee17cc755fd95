import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm.alignment import EMPTY, Fragment, Tokens, align, both_of, brute_force, composed, fragment, op11_alignment, summary

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
rng = random.Random(3)
PARTS = ["word", "Hello", " ", "  ", "\n", "\t", "\r", "\r\n", "x", ",", "...", "'ll", "don't", "été", "中文テキスト", "🙂🙂", "12345", "=" * 40, " " * 30, "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\x00", "　", "\xa0", "a" * 70, ");\r", "\x1c"]
TEXTS = [None, "", " ", "a", "\n", "\r", "The quick brown fox", "é" * 60, "word\r\nnext \r \rx", "tail  ", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60))) for _ in range(120))]
ODD = ["a▁b", "▁", "fine ▁ and more words " * 30]
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def check(rows, texts):
    want = brute_force(texts, A, B)
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r["doc_id"]]
        assert tuple(r[n] for n in NAMES) == w, (texts[r["doc_id"]], [x for x in zip(NAMES, (r[n] for n in NAMES), w) if x[1] != x[2]])
        assert r["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")


@pytest.mark.parametrize("chunk, checked", [(1 << 16, 1 << 20), (40, 1 << 20), (7, 0)])
def test_against_brute_force(spark, chunk, checked):
    texts = [*TEXTS, *ODD, "x" * 500 + "y z" * 50, ("no space, but:marks" * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as row", "2 as n_a", "'q' as GROUPS").repartition(3)
    out = align(docs, A, B, chunk=chunk, groups=True, checked_pairs=checked)
    assert out.columns == ["doc_id", *NAMES[:-1], "groups_sha256", "groups"]
    check(out.collect(), texts)
    assert align(docs.limit(0), A, B, chunk=chunk).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, "same"), (1, "other")], "doc_id long, text string")
    rows = align(docs, A, B).collect()
    want = brute_force(["same text", "same text", "same", "other"], A, B)
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in rows) == sorted((i, w[0], w[5]) for i, w in zip((0, 0, 1, 1), want))


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(docs)
    want = dict(zip(ids, brute_force([docs[i] for i in ids], A, B)))
    rows = op11_alignment(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r["doc_id"]]
        assert (*[r[n] for n in NAMES[:-1]], r["groups_sha256"]) == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")


def random_tokens(n):
    ends = lambda: np.array(sorted(set(rng.sample(range(1, n), n // 3)) | {n}))
    a, b = ends(), ends()
    return Tokens(np.arange(len(a)), a, np.arange(len(b)) + 1000, b)


def same(x, y):
    return all(np.array_equal(p, q) for p, q in zip(x, y))


def test_fragments_compose_in_any_order():
    for _ in range(300):
        whole = random_tokens(60)
        # A and B are cut at places of their own, as ranges are.
        cuts_a, cuts_b = (sorted(rng.choices(range(len(x) + 1), k=3)) for x in (whole.a, whole.b))
        parts = []
        for i, j in zip(itertools.pairwise([0, *cuts_a, len(whole.a)]), itertools.pairwise([0, *cuts_b, len(whole.b)])):
            parts.append(fragment(Tokens(whole.a[slice(*i)], whole.a_end[slice(*i)], whole.b[slice(*j)], whole.b_end[slice(*j)])))

        def fold(order):
            """Composes neighbours in the given order; all closed tokens by place."""
            now, closed = [p[0] for p in parts], [p[1] for p in parts if len(p[1].a)]
            for k in order:
                made, more = composed(now[k], now[k + 1])
                now[k : k + 2] = [made]
                if len(more.a):
                    closed.append(more)
            total = EMPTY
            for c in sorted(closed, key=lambda c: c.a_end[0]):
                total = total.before(c)
            return now[0], total

        want, rest = fragment(whole)
        for order in ((0, 0, 0), (2, 1, 0), (0, 1, 0), (1, 1, 0), (2, 0, 0)):
            made, closed = fold(order)
            assert same(made.head, want.head) and same(made.tail, want.tail) and made.closed == want.closed and same(closed, rest)
        unit = Fragment(EMPTY, EMPTY, False)
        for made, _ in (composed(unit, want), composed(want, unit)):
            assert same(made.head, want.head) and same(made.tail, want.tail)


def test_links_in_small_blocks(monkeypatch):
    from tidemark.llm import alignment

    both, tokens = both_of(A, B), random_tokens(300)
    zero = lambda x: np.zeros(len(x), np.int64)
    want = summary(both, tokens, zero(tokens.a), zero(tokens.b), 1)
    monkeypatch.setattr(alignment, "LINKS", 3)
    got = summary(both, tokens, zero(tokens.a), zero(tokens.b), 1)
    assert same((want.pair, want.times), (got.pair, got.times)) and want.times.sum() == want.n_links[0]


def test_cuts_cover_the_text_once():
    both = both_of(A, B)
    for text in [t for t in TEXTS if t] + ["longword" * 400, "a b" * 200]:
        for chunk in (1, 5, 64):
            cuts = list(both.cut(text, chunk))
            assert "".join(c[1] for c in cuts) == text == "".join(c[3] for c in cuts)
            assert all(c[2] == len("".join(x[1] for x in cuts[:k]).encode()) for k, c in enumerate(cuts))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        both_of(public_tokenizers.path("word_bpe_49k.json"), B)
