import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import base, near_copies
from tidemark.llm.near_copies import brute_force


def made(seed, n=40):
    rng = random.Random(seed)
    say = lambda k: [rng.choice("tide mark shore wave sand stone light wind rope sail".split()) + str(rng.randrange(30)) for _ in range(k)]
    line, out = say(12), []
    for _ in range(n):
        words = say(rng.randrange(3, 90)) + line * rng.randrange(2)
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy))
    return out + ["", " \n", None, "one two", "One  two", out[0].upper()]


def parts(texts, names):
    first: dict = {}
    return [first.setdefault(x, i) for i, x in enumerate(names)]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["row"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    return parts(texts, [got[i] for i in range(len(texts))])


def test_components_against_brute_force(spark):
    texts = made(1)
    want = brute_force(texts)
    assert len(set(want)) < len(texts) - 20
    assert found(spark, texts) == want


def test_large_buckets_give_the_same(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("NEAR", 1), ("LIMIT", 4), ("COMMON", 10**9)):
        monkeypatch.setattr(near_copies, name, value)
    texts = made(2)
    assert found(spark, texts) == brute_force(texts)


def test_stage_catches_copies_beyond_three_bits(spark):
    texts = made(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()
    want = brute_force(texts)
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))


def test_stage_keeps_unrelated_rows_of_null_and_repeated_ids(spark):
    texts = ["red sails at dawn over the bay", "cold sand under the old pier", "a lamp in the harbour office", "ropes and nets dry in the sun", "gulls follow the last boat home", "nobody counts the waves at night"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (4, texts[2]), (4, texts[3]), (4, texts[3]), (4, texts[4]), (5, texts[4]), (None, texts[4]), (6, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(None, texts[0]), (None, texts[1]), (4, texts[2]), (4, texts[3]), (4, texts[4]), (6, texts[5])}
    for parts in (1, 3):
        got = [tuple(r) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs.repartition(parts), "").collect()]
        assert len(got) == len(want) and set(got) == want


def test_signatures_never_rule_out_similar_sets():
    rng = np.random.default_rng(6)
    ruled_out = 0
    for n in (1, 5, 90, 1000, 1030, 5000):
        for share in (0.0, 0.3, 0.7, 0.82, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 1 << 63, max(1, int(n * (1 - share) / 2))).astype(np.uint64)]))
            may = near_copies.may_be_similar(near_copies.signature(a), near_copies.signature(b), len(a), len(b))
            assert may or not near_copies.similar(a, b)
            ruled_out += not may
    assert ruled_out >= 15


def test_a_large_bucket_is_not_held(monkeypatch):
    monkeypatch.setattr(near_copies, "HELD", 64)
    n = 300
    columns = [np.zeros(n), np.arange(n), np.full(n, 100), np.zeros(n), np.arange(n)]
    table = pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["key", "node", "size", "at", "root"])
    rows = [tuple(r.values()) for b in near_copies._meet(iter(table.to_batches(max_chunksize=50))) for r in b.to_pylist()]
    assert [r for r in rows if r[1] is None] == [(0, None, n)]
    pairs = {r[:2] for r in rows if r[1] is not None}
    assert {(i, i + k) for k in range(1, near_copies.NEAR + 1) for i in range(n - k)} <= pairs and len(pairs) < 10 * n


def test_pairs_that_signatures_leave_open():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(90)]
    sets.append(rng.integers(0, 2**63, 3000).astype(np.uint64))  # its signature is longer
    root = np.arange(len(sets)) // 2
    side = np.arange(len(sets)) % 3 > 0
    columns = [np.zeros(len(sets), np.int64), np.arange(len(sets)), np.array([len(x) for x in sets]), root, side.astype(np.int64)]
    table = pa.table([*map(pa.array, columns), pa.array([near_copies.signature(x) for x in sets])], names=["key", "node", "size", "root", "side", "bits"])
    run = lambda best: {tuple(r.values()) for b in near_copies._meet_signed(best)(iter(table.to_batches(max_chunksize=20))) for r in b.to_pylist()}
    open_ = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and side[i] != side[j]}
    similar = {(i, j) for i, j in open_ if near_copies.similar(sets[i], sets[j])}
    every, best = run(False), run(True)
    assert similar and similar <= every <= open_ and best <= every
    assert all(any(i in p for p in best) for i in {x for p in every for x in p})


def test_large_sets_of_a_bucket_do_not_leave_all_pairs():
    import numpy as np
    import pyarrow as pa

    from tidemark.llm.near_copies import _meet_signed, signature

    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, 6_000, dtype=np.uint64) for _ in range(60)]
    sets.append(np.concatenate([sets[0][:5_900], sets[1][:100]]))  # a near copy of the first
    n = len(sets)
    longs = [pa.array(x, pa.int64()) for x in ([7] * n, range(n), map(len, sets), range(n), [0] * n)]
    batch = pa.RecordBatch.from_arrays([*longs, pa.array([signature(s) for s in sets])], names=["key", "node", "size", "root", "side", "signature"])
    for best in (True, False):
        got = [tuple(r.values()) for out in _meet_signed(best)([batch.slice(0, 20), batch.slice(20)]) for r in out.to_pylist()]
        assert got == [(0, n - 1)]


def test_a_pair_is_made_in_the_first_of_its_buckets_only():
    from tidemark.llm.near_copies import _meet_signed, similar, signature

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = [np.concatenate([base[:380], fresh(20)]) for _ in range(4)]
    apart = [np.concatenate([rng.choice(base, 345, replace=False), fresh(55)]) for _ in range(30)]  # similar to 0.6 among themselves
    sets = near + apart
    n, keys = len(sets), [3, 5, 9]
    rows = [(key, i, len(x), i, 0, signature(x), [k for k in keys if k < key]) for key in keys for i, x in enumerate(sets)]
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["key", "node", "size", "root", "side", "signature", "less"])
    made = [tuple(r.values()) for out in _meet_signed(False)(iter(table.to_batches(max_chunksize=25))) for r in out.to_pylist()]
    want = {(i, j) for j in range(n) for i in range(j) if similar(sets[i], sets[j])}
    assert len(made) == len(set(made)) and want <= set(made)
    assert len(made) < n * (n - 1) // 2 // 10
    best = [tuple(r.values()) for out in _meet_signed(True)(iter(table.to_batches(max_chunksize=25))) for r in out.to_pylist()]
    assert len(best) == len(set(best)) and set(best) <= set(made) and {0, 1, 2, 3} <= {i for p in best for i in p}


def test_stage_keeps_no_copy_of_the_texts_and_moves_them_once(spark, monkeypatch):
    texts = [t for t in made(4, n=60) if t]
    kept_tables, written = [], base.written
    monkeypatch.setattr(base, "written", lambda df, name: kept_tables.append((name, df.columns, (out := written(df, name)).count())) or out)
    out = corpus_pipeline.keep_one_of_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # the rows that stay, by name
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(brute_force(texts)))
    assert kept_tables and not [x for x in kept_tables if "text" in x[1] and x[2] >= len(texts)]


def test_stage_takes_other_names_when_two_rows_share_one(spark, monkeypatch):
    texts = made(5, n=15)
    own = corpus_pipeline.content_hash
    monkeypatch.setattr(corpus_pipeline, "content_hash", lambda content, salt: own(content, salt) if salt > 1 else F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute_force(texts)))


def test_stage_with_many_rows_that_come_again(spark, monkeypatch):
    texts = ["red sails at dawn over the bay", "cold sand under the old pier", "a lamp in the harbour office"]
    docs = spark.createDataFrame([(i % 4, texts[i % 3]) for i in range(60)], "doc_id long, text string")
    for most in (corpus_pipeline.CHECKED_ROWS, 2):
        monkeypatch.setattr(corpus_pipeline, "CHECKED_ROWS", most)
        got = sorted(tuple(r) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect())
        assert got == sorted((0, t) for t in texts)


def test_brief_signatures_are_small_and_never_rule_out_similar_sets():
    rng = np.random.default_rng(7)
    for n in (1, 90, 400, 1030, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        whole = near_copies.signature(a)
        assert len(near_copies.brief(whole)) * 8 <= max(near_copies.BITS, 2 * n)
        for share in (0.0, 0.5, 0.82, 0.9, 1.0):
            b = np.unique(np.concatenate([a[rng.random(n) < share], rng.integers(0, 1 << 63, max(1, int(n * (1 - share) / 2)), dtype=np.uint64)]))
            may = near_copies.may_be_similar(near_copies.brief(whole), near_copies.brief(near_copies.signature(b)), n, len(b))
            assert may or not near_copies.similar(np.unique(a), b)
            assert not (may and share == 0 and n > 1)
