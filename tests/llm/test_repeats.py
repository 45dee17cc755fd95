import random

import duckdb
import numpy as np

from tidemark.llm import repeats
from tidemark.llm.repeats import RunLengthIndex, brute_force, op10_repeats, remove_repeats


def result(df):
    from pyspark.sql import functions as F

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    out = df.select("doc_id", size, size - F.octet_length("kept_bytes"), (F.size("removed_spans") / 2).cast("long"), F.sha2("kept_bytes", 256))
    return {r[0]: tuple(r)[1:] for r in out.collect()}


def made(seed):
    rng = random.Random(seed)
    say = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    shared = [say(n) for n in (399, 400, 401, 650, 1500, 330)]
    docs = [say(rng.randrange(300)) + rng.choice(shared) + say(rng.randrange(300)) + rng.choice(shared)[: rng.randrange(1, 1500)] for _ in range(60)]
    docs += [docs[0], docs[1], docs[2][:700] + "#" + docs[2][701:], "a" * 399, "a" * 400, "a" * 401, "ab" * 300, None, "", say(399)]
    return list(enumerate(docs))


def test_matching_statistics_against_brute_force():
    rng = random.Random(9)
    for _ in range(20):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(2, 8))]
        strings += [strings[0]]
        index = RunLengthIndex(strings)
        places = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]

        def match(p, q):
            x, y = strings[p[0]][p[1] :], strings[q[0]][q[1] :]
            return next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))

        want = [max(match(p, q) for q in places if q != p) for p in places]
        got = index.matching_statistics()
        assert [got[index.begins[k] + i] for k, i in places] == want
        assert len(index.heads) <= len(index.data)


def test_runs_are_few_on_copies():
    base = bytes(np.random.default_rng(0).integers(97, 123, 500).astype(np.uint8))
    index = RunLengthIndex([base] * 50)
    assert len(index.heads) < len(index.data) / 20


def test_made_texts(spark):
    docs = made(1)
    assert result(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_force(docs)


def test_small_limits_give_the_same(spark, monkeypatch):
    for name, value in (("LIMIT", 2), ("CHUNK", 1500), ("SEGMENT", 700)):
        monkeypatch.setattr(repeats, name, value)
    docs = made(2)
    assert result(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_force(docs)


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r)[1:5] for r in op10_repeats(spark, sf).collect()}
    assert got == brute_force(docs)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, key long, spans string")).count() == 0


def test_common_prefixes_in_bounded_blocks():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 256, 60, np.uint8).tobytes()
    strings = [base, base[:33] + b"\xff\x01" + base[35:], base[7:50], b"\x80" * 20, b"\x80" * 9, b""]
    index = repeats.RunLengthIndex(strings)
    n = len(index.data)
    x, y = (z.ravel() for z in np.meshgrid(np.arange(n), np.arange(n)))
    rest = [index.data[i : index.ends[i]].tobytes() for i in range(n)]
    want = [next((k for k, (p, q) in enumerate(zip(rest[i], rest[j])) if p != q), min(len(rest[i]), len(rest[j]))) for i, j in zip(x.tolist(), y.tolist())]
    assert index.common(x, y).tolist() == want
    assert repeats.CHUNK <= 250_000 and repeats.SEGMENT <= 250_000  # a worker's arrays are of some times these sizes
