import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm.pieces import Lattices, Vocabulary, decode_pieces, encode_samples, op5_pieces, sample

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def words():
    return Vocabulary(PATH)


def every(words, text):
    """All segmentations with their normalised probabilities, by plain recursion."""
    s = "▁" + text.replace("▁", "\0").replace(" ", "▁")
    of = {p: i for i, p in enumerate(words.pieces) if np.isfinite(words.weight[i])}

    def go(i):
        if i == len(s):
            yield (), 0.0
            return
        for j in range(i + 1, min(len(s), i + 16) + 1):
            piece = s[i:j]
            if piece in of:
                own, w = (of[piece],), words.weight[of[piece]]
            elif j == i + 1:
                raw = piece.replace("\0", "▁").encode()
                own, w = tuple(int(words.byte_id[b]) for b in raw), len(raw) * words.byte_weight
            else:
                continue
            for rest, x in go(j):
                yield own + rest, w + x

    found = dict(go(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


def drawn(words, texts, seeds, k):
    lattices = Lattices(words, texts)
    paths, threshold = sample(lattices, np.array(seeds, np.uint64), k)
    out = [[] for _ in texts]
    for j, p in enumerate(paths):
        ids, count = lattices.ids(p.row, p.length)
        ends = np.concatenate([[0], np.cumsum(count)])[p.edge_bounds]
        for i in range(len(texts)):
            if j == 0 or np.isfinite(p.value[i]):
                out[i].append((tuple(ids[ends[i] : ends[i + 1]].tolist()), float(p.total[i]), float(p.value[i])))
    return out, threshold


@pytest.mark.parametrize("text", ["the cat", "a  b", "né 中\n▁x", "!!", "x", " "])
def test_all_segmentations_come_without_repeats(words, text):
    want = every(words, text)
    k = min(len(want) + 3, 400)
    (got,), threshold = drawn(words, [text], [5], k)
    assert len({g[0] for g in got}) == len(got) == min(len(want), k)
    for ids, log_prob, _ in got:
        assert math.isclose(log_prob, want[ids], abs_tol=1e-4)
    values = [g[2] for g in got]
    assert values == sorted(values, reverse=True)
    assert (threshold[0] == -np.inf) == (len(want) < k)


def test_distribution_of_ordered_pairs(words):
    """First and second sample follow sampling without replacement: p(a) * p(b) / (1 - p(a))."""
    want = {k: math.exp(v) for k, v in every(words, "ab c").items()}
    n = 40_000
    got, _ = drawn(words, ["ab c"] * n, np.arange(n), 2)
    pairs = Counter((g[0][0], g[1][0]) for g in got)
    for (a, b), count in pairs.most_common(6):
        p = want[a] * want[b] / (1 - want[a])
        assert abs(count / n - p) < 5 * math.sqrt(p / n) + 1e-4, (count / n, p)
    first = Counter(g[0][0] for g in got)
    for a, count in first.most_common(5):
        assert abs(count / n - want[a]) < 5 * math.sqrt(want[a] / n)


def test_library_reads_the_ids(words, spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [(1, "Hello  wörld\n 中文 x"), (2, ""), (3, None), (4, " lead"), (5, "🙂 ▁ mark"), (6, "e" * 3000), (None, "nul key"), (7, "Tab\tend ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as sample", "2 as ids")
    rows = decode_pieces(encode_samples(df, PATH, "doc_id", k=3), PATH).collect()
    by = dict(texts)
    for r in rows:
        text = by[r["doc_id"]] or ""
        assert r["round_trip"] and r["decoded"] == text and 0 <= r["inclusion"] <= 1
        if "▁" not in text:
            assert model.decode(r["ids"]) == text
    assert Counter(r["doc_id"] for r in rows) == {1: 3, 2: 1, 3: 1, 4: 3, 5: 3, 6: 3, None: 3, 7: 3}
    again = encode_samples(df.repartition(3), PATH, "doc_id", k=3).collect()
    assert {(r["doc_id"], r["sample"]): r["ids"] for r in again} == {(r["doc_id"], r["sample"]): r["ids"] for r in rows}


def test_given_tables(spark):
    out = op5_pieces(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len(rows) == 400 and all(r["round_trip"] for r in rows)
    assert len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == 400


def test_empty(spark):
    assert encode_samples(spark.createDataFrame([], "doc_id long, text string"), PATH, "doc_id").count() == 0


def test_drawn_edges_are_those_of_a_plain_count():
    for texts in (["the reason is"], ["a b", "", "ünd\u2581x"], ["international responsibilities " * 3]):
        lattices = Lattices(Vocabulary(public_tokenizers.path("piece_bpe_32k.model")), texts)
        shares = lattices.below[:, : lattices.width]
        row = np.repeat(np.arange(len(shares)), 40)
        u = np.random.default_rng(1).random(len(row)).astype(np.float32)
        took = lattices.drawn(row, u)
        assert took.tolist() == np.minimum((u[:, None] > shares[row]).sum(axis=1) + 1, lattices.width).tolist()
        assert (lattices.edge_of(row, took.astype(np.int64)) == lattices.edge[row, took.astype(np.int64) - 1]).all()
