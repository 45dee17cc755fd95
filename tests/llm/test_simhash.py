import random

import numpy as np
import duckdb

from tidemark.llm import simhash
from tidemark.llm.simhash import brute_force, components, fingerprint, forest, links, op1_simhash


def test_fingerprint_is_the_majority_of_shingles():
    import xxhash

    words = "the QUICK brown\tfox  jumps é".split()
    low = [w.lower() for w in words]
    hashes = [xxhash.xxh64_intdigest(" ".join(low[i : i + 3]).encode(), 42) for i in range(len(low) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint(" ".join(words).encode()) == want
    assert fingerprint(b" \t\n") == 0
    assert fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_forest_links_what_is_close():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    prints = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in range(7)])
    keys = np.sort(rng.integers(0, 3, len(prints)))
    got = forest(keys, prints)
    up = list(range(len(prints)))
    for _ in range(len(prints)):
        for i in range(len(prints)):
            for j in range(len(prints)):
                if keys[i] == keys[j] and int(prints[i] ^ prints[j]).bit_count() <= 3:
                    up[i] = min(up[i], up[j])
        if up == (new := [up[u] for u in up]):
            break
        up = new
    assert got.tolist() == up


def test_links_with_tiny_limit(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {0}
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.sample(range(64), rng.randrange(9)):
                x ^= 1 << bit
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    monkeypatch.setattr(simhash, "LIMIT", 8)
    found = components(links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    got = {r["node"]: r["root"] for r in found.collect()}
    up = {x: x for x in signed}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in signed:
        for j in signed:
            if i < j and ((i ^ j) & (1 << 64) - 1).bit_count() <= 3 and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {x: root(x) for x in signed} == {x: got.get(x, x) for x in signed}


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash(spark, sf).collect()}
    assert got == brute_force(docs)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(3, None), (2, ""), (9, "a"), (9, "a")], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as least")
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").collect()) == [(2, 2), (3, 2), (9, 9), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_fingerprint_for_half_the_rows(spark):
    rows = [(i, "the same words in every one of these rows") for i in range(0, 1200, 2)] + [(i, f"row {i} has words {i * 7} of its own {i * i}") for i in range(1, 1200, 2)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1k")
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: c for i, (_, c) in brute_force(rows).items()} and all(got[i] == 0 for i in range(0, 1200, 2))
