import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk
from tidemark.llm.topk import OP2_SQL, SlicedIndex, op2_topk, top_k
from tests.oracle import compare


def test_slices_add_up():
    rng = np.random.default_rng(0)
    v = rng.integers(-500, 500, (150, 9))
    index = SlicedIndex(v)
    q = rng.integers(-300, 300, 9)
    code = (v - index.low) >> index.shift
    want = (np.abs(q) * np.where(q > 0, code, (1 << index.slices) - 1 - code)).sum(axis=1)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:150].astype(np.int64) for s in index.score_slices(q)]
    assert np.array_equal(sum(b << i for i, b in enumerate(bits)), want)


def brute(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 32768])
def test_ties_copies_and_bad_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block * 6 * 2)
    monkeypatch.setattr(topk, "LEAST", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1, 6).round(1).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 400)] + [(400, [0.5] * 6), (401, None), (402, [None] * 6), (500, [float("nan")] * 6), (501, [float("inf")] * 6), (600, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in df.collect()]
    assert sorted(tuple(r) for r in top_k(df, lambda i: i % 100 == 0).collect()) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, lambda i: i % 100 == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_given_tables(spark):
    compare(spark, "/root/testdata/sf0.001", op2_topk, OP2_SQL)


def test_wide_components_and_what_would_wrap(spark):
    rng = np.random.default_rng(9)
    for scale in (1.0, 1e3, 1e5):  # components of two, four and eight bytes
        rows = [(i, (rng.normal(0, scale, 5)).tolist()) for i in range(250)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "'x' as ids", "2 as block")
        assert sorted(tuple(r) for r in top_k(df, lambda i: i % 100 == 0).collect()) == brute(rows)
    with pytest.raises(ValueError, match="range"):
        top_k(spark.createDataFrame([(0, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>"), lambda i: i % 100 == 0)


def test_memory_is_bounded_by_bytes():
    import tracemalloc

    tracemalloc.start()
    vectors = np.random.default_rng(1).integers(-1000, 1000, (topk.BLOCK_BYTES // 2 // 1536, 1536), dtype=np.int16)
    SlicedIndex(vectors)
    assert tracemalloc.get_traced_memory()[1] < 350e6
    tracemalloc.stop()


def test_small_tables_are_few_blocks(spark):
    rows = spark.range(6_000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("embedding"))
    found = top_k(rows, lambda i: i % 3_000 == 0)
    assert "Exchange SinglePartition, REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20
