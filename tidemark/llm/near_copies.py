"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and their components.

1. Shingles are named by XXH64; a text's set by the hash of its sorted shingles (a node; equal sets are one node). Sets
   whose SimHash fingerprints differ in few bits are found by the operator of simhash.py; of its spanning links those
   that a comparison in full confirms make the first components. What follows finds the rest.
2. Two sets of at least 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, in any order that is the
   same for all. Shingles that a sample of texts shows to be common come last in it, so that few sets meet by them.
   Sets that meet are candidates unless their sizes or the places of the shared shingle rule 0.8 out.
3. Each set has a signature, the bits that its shingles fall on. A bit of one set that the other lacks is a shingle
   that is not shared, which rules most candidates out: first by a part of the bits, laid over each other, as all candidates
   take these along, then by all. The rest are compared in full on their texts: first one candidate of each set, then
   those that are not in one component yet.
4. A bucket of more than `SMALL` sets is compared in three rounds: one set of each component with its neighbours by size
   first; then in parts of `LIMIT` sets each set with that of another component whose signature is likeliest; then all
   pairs of different components that the signatures do not rule out.

Defined cases: words are those of the fingerprints of simhash.py; a text of fewer words than a shingle is one shingle;
texts without words are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import Tables, appended, checked, in_tasks, sliced, small_batches
from tidemark.llm.simhash import SEED, components, links, majority

WORDS = 5
SHARE = (4, 5)  # the similarity, as a fraction
SAMPLE, COMMON, MOST = 2_000, 4, 100_000
SMALL, NEAR, LIMIT = 64, 4, 4096
BLOCK = 16  # sets that are compared with a part of a bucket at once
BITS, HELD = 1024, 1 << 16
WIDE = 8  # bits of a signature for each shingle, so that few pairs below the similarity are left to a comparison in full
COMPARED = 2_000_000  # bytes of signatures that are compared at once
BRIEF = 8  # a signature that goes along with candidates, or into buckets, has so many times fewer bits, but BITS at least
LISTED = 16  # keys of a set that are known in its buckets: two sets that may be similar have most of their keys in common


def shingles(text: bytes) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(WORDS))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(words) - WORDS + 1))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which any set of the given similarity has one among its own."""
    n = len(found)
    if not n:
        return found
    late = np.isin(found, common, assume_unique=True)
    return np.concatenate([found[~late], found[late]])[: n - -(-n * SHARE[0] // SHARE[1]) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SHARE[1] >= SHARE[0] * (len(a) + len(b) - both)


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles of many texts of a sample, sorted. What is in it decides the work, never the result."""
    step = max(1, docs.count() // SAMPLE)

    def run(batches):
        for part in (p for batch in batches for p in sliced(batch, 0)):
            for text in part.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text or b"").view(np.int64))], names=["key"])

    some = small_batches(docs).where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("text").limit(2 * SAMPLE)
    found = some.mapInArrow(in_tasks(run), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["key"] for r in found.orderBy(F.desc("n"), "key").limit(MOST).collect()], np.int64).view(np.uint64))


def signature(found: np.ndarray) -> bytes:
    """The bits that the shingles fall on: BITS, or the power of two from WIDE times the set's size on."""
    bits = np.zeros(max(BITS, 1 << max(0, WIDE * len(found) - 1).bit_length()), bool)
    bits[(found & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def brief(bits: bytes) -> bytes:
    return _folded(bits, max(BITS // 8, len(bits) // BRIEF))


def may_be_similar(one: bytes, two: bytes, size_one: int, size_two: int) -> bool:
    """False if the bits rule the similarity out: each bit that only one of two sets has is a shingle that only it has."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    most = min(size_one - int(np.bitwise_count(x & ~y).sum()), size_two - int(np.bitwise_count(y & ~x).sum()))
    return most * sum(SHARE) >= SHARE[0] * (size_one + size_two)


def _sets(docs: DataFrame) -> DataFrame:
    """`docs` without text plus node, size, first, the shingles of the prefix, the signature, whole and brief, and the fingerprint."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def make():
        late = common.value

        def run(column: pa.Array) -> list[pa.Array]:
            sets = [shingles(t or b"") for t in column.cast(pa.binary()).to_pylist()]
            prints = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            longs, signed = pa.list_(pa.int64()), [signature(s) for s in sets]
            return [pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array([prefix(s, late).view(np.int64) for s in sets], longs), pa.array(signed, pa.binary()), pa.array([brief(x) for x in signed], pa.binary()), pa.array(prints)]

        return run

    return appended(docs, "text", [("node", T.LongType()), ("size", T.IntegerType()), ("first", T.ArrayType(T.LongType())), ("signature", T.BinaryType()), ("brief", T.BinaryType()), ("fp", T.LongType())], make, drop=True)


def _pairs(x: np.ndarray, y: np.ndarray, node, size, at) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs x, y of rows with a shingle in common the nodes of those that may be similar, the smaller node first."""
    most = np.minimum(size[x] - at[x], size[y] - at[y])  # nothing before the first shared shingle is shared
    ok = (node[x] != node[y]) & (most * (SHARE[0] + SHARE[1]) >= SHARE[0] * (size[x] + size[y]))
    a, b = node[x[ok]], node[y[ok]]
    return np.minimum(a, b), np.maximum(a, b)


def _meet(batches):
    """Rows (key, node, size, at, root), sorted by key and never a key in two tasks, to candidates (a, b, 0) of different roots.

    Every pair of a bucket up to SMALL; of a larger one a set of each component with its neighbours and with the first;
    such a bucket has a row (key, null, size) as well. Of it no more than about HELD rows are held.
    """

    def bucket(node, size, at, root, large=False):
        if len(node) > SMALL or large:
            some, large = np.sort(np.unique(root, return_index=True)[1]), True
            node, size, at, root = (c[some] for c in (node, size, at, root))
        n = len(node)
        for step in range(1, min(n, NEAR + 1) if large else n):
            x = np.arange(n - step)
            y = x + step
            ok = root[x] != root[y]
            yield _pairs(x[ok], y[ok], node, size, at)
        if large and n > 1:
            yield _pairs(np.zeros(n - 1, np.int64), np.arange(1, n), node, size, at)

    rest = [np.empty(0, np.int64)] * 5
    before = 0  # rows of the key of `rest` that were met and are no longer held

    def found(columns, before):
        key = columns[0]
        ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1 if len(key) else []
        out, large, start = [], [], 0
        for end in ends:
            n = end - start + before
            if n > SMALL:
                large.append((key[start], n))
            if end - start > 1:
                out += bucket(*(c[start:end] for c in columns[1:]), large=before > 0)
            start, before = end, 0
            if len(out) > 1000:
                yield from flush(out)
                out = []
        yield from flush(out)
        if large:
            keys, sizes = np.array(large, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.int64()), pa.array(sizes)], names=["a", "b", "n"])

    def flush(out):
        a = np.concatenate([o[0] for o in out]) if out else []
        if len(a):
            pair = np.unique(np.stack([a, np.concatenate([o[1] for o in out])], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(np.zeros(len(pair), np.int64))], names=["a", "b", "n"])

    for batch in batches:
        columns = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, r in enumerate(rest)]
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        if cut:
            yield from found([c[:cut] for c in columns], before)
            before = 0
        rest = [c[cut:] for c in columns]
        if len(rest[0]) > HELD:
            yield from flush(list(bucket(*rest[1:], large=True)))
            before += len(rest[0]) - NEAR
            rest = [c[-NEAR:] for c in rest]
    yield from found(rest, before)


def _meet_signed(best: bool):
    """Rows (key, node, size, root, side, bits, less), sorted by key and never a key in two tasks, to pairs (a, b) that the bits leave possible.

    Pairs of different roots, and of different sides where there are two: all of them, or of each set the likeliest.
    A part of a bucket has no more than about 2 * LIMIT sets, which are compared in blocks, by BITS bits at first; what
    passes is compared by the whole signatures. `less` has keys of the set's other buckets that come before this one: two sets
    with such a key in common meet there, so each pair is looked at in the first of its buckets only.
    """

    def bucket(node, size, root, side, bits, whole, less):
        both = side.min() != side.max()
        for i in range(0, len(node), BLOCK):
            x = slice(i, i + BLOCK)
            lacks = np.bitwise_count(bits[x, None] & ~bits[None]).sum(axis=2, dtype=np.int64)
            extra = np.bitwise_count(~bits[x, None] & bits[None]).sum(axis=2, dtype=np.int64)
            most = np.minimum(size[x, None] - lacks, size[None] - extra)
            total = size[x, None] + size[None]
            ok = (most * sum(SHARE) >= SHARE[0] * total) & (root[x, None] != root[None])
            if both:
                ok &= side[x, None] != side[None]
            if not best:
                ok &= np.arange(i, i + ok.shape[0])[:, None] < np.arange(len(node))
            one, two = np.nonzero(ok)
            first = np.fromiter((less[x].isdisjoint(less[y]) for x, y in zip((one + i).tolist(), two.tolist())), bool, len(one))
            one, two = one[first], two[first]
            found = _most_shared(whole, size, one + i, two)
            may = found * sum(SHARE) >= SHARE[0] * total[one, two]
            one, two, found = one[may], two[may], found[may]
            if best and len(one):
                share = np.full(ok.shape, -1.0)
                share[one, two] = found / total[one, two]
                one = np.unique(one)
                two = share[one].argmax(axis=1)
            if len(one):
                a, b = node[one + i], node[two]
                yield np.minimum(a, b), np.maximum(a, b)

    def pairs(columns):
        key, out = columns[0], []
        ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1 if len(key) else []
        start = 0
        for end in ends:
            out += bucket(*(c[start:end] for c in columns[1:]))
            start = end
        if out:
            pair = np.unique(np.stack([np.concatenate(x) for x in zip(*out)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

    def run(batches):
        rest = [np.empty(0, np.int64)] * 5 + [np.empty((0, BITS // 64), np.uint64), np.empty(0, object), np.empty(0, object)]
        for batch in batches:
            whole, less = np.empty(batch.num_rows, object), np.empty(batch.num_rows, object)
            whole[:] = batch.column(5).to_pylist()
            less[:] = [frozenset(x or ()) for x in (batch.column(6).to_pylist() if batch.num_columns > 6 else [None] * batch.num_rows)]
            bits = np.frombuffer(b"".join(map(_folded, whole)), np.uint64).reshape(-1, BITS // 64)
            columns = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, r in enumerate(rest[:5])] + [np.concatenate(x) for x in zip(rest[5:], (bits, whole, less))]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            yield from pairs([c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
        yield from pairs(rest)

    return run


def _folded(bits: bytes, size: int = BITS // 8) -> bytes:
    """A signature of so many bytes: the parts of a longer one laid over each other."""
    return bits if len(bits) == size else np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size)).tobytes()


def _most_shared(whole: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair share at most, by as many bits as both signatures have."""
    width = np.fromiter(map(len, whole), np.int64, len(whole))
    least, out = np.minimum(width[one], width[two]), np.empty(len(one), np.int64)
    for w in np.unique(least).tolist():
        of = np.flatnonzero(least == w)
        for at in np.split(of, range(step := max(1, COMPARED // w), len(of), step)):
            used, where = np.unique(np.concatenate([one[at], two[at]]), return_inverse=True)
            bits = np.frombuffer(b"".join(_folded(whole[k], w) for k in used.tolist()), np.uint64).reshape(len(used), -1)
            x, y = bits[where[: len(at)]], bits[where[len(at) :]]
            lacks, extra = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x & ~y, ~x & y))
            out[at] = np.minimum(size[one[at]] - lacks, size[two[at]] - extra)
    return out


def _candidates(rows: DataFrame, tables: Tables) -> DataFrame:
    """(a, b, n) as of `_meet`, each once."""
    # These are the most rows of all, so they travel in fewer bytes: most sets are their own root.
    moved = rows.select("key", "node", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("at")).alias("both"), F.when(F.col("root") != F.col("node"), F.col("root")).alias("root")).repartition("key")
    sorted_rows = moved.select("key", "node", F.shiftright("both", 32).alias("size"), F.pmod("both", F.lit(1 << 32)).alias("at"), F.coalesce("root", "node").alias("root")).sortWithinPartitions("key", "size", "node")
    return tables.written(sorted_rows.mapInArrow(in_tasks(_meet), "a long, b long, n long").distinct(), "near")


def _open_pairs(rows: DataFrame, single: DataFrame, best: bool, name: str, tables: Tables) -> DataFrame:
    """(a, b), each once, as of `_meet_signed`: of rows (key, node, size, root, n) of buckets that hold more than one component.

    A bucket of more than LIMIT sets is dealt into parts, of which each pair meets once.
    """
    mixed = tables.written(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), f"mixed_{name}")
    parts = F.ceil(F.col("n") / LIMIT).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    rows = rows.join(mixed, "key")
    rows = tables.written(rows, f"met_{name}")
    keys = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LISTED).alias("keys"))
    rows = rows.join(keys.join(single.select("node", "brief"), "node"), "node").withColumn("less", F.filter("keys", lambda k: k < F.col("key")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("side", F.when(own == F.col("other"), 0).otherwise(F.when(own < F.col("other"), 1).otherwise(2)))
    rows = rows.withColumn("key", F.when(parts == 1, F.col("key")).otherwise(F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other"))))
    rows = rows.select("key", "node", "size", "root", "side", "brief", "less").repartition("key").sortWithinPartitions("key")
    return tables.written(small_batches(rows).mapInArrow(in_tasks(_meet_signed(best)), "a long, b long").distinct(), name)


def _likely(pairs: DataFrame, sets: DataFrame, bits: str) -> DataFrame:
    """The pairs (a, b) that the signatures of the column `bits` do not rule out, with a row of each."""
    one, two = (sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{y}_{c}") for x, y in (("row", "row"), ("size", "size"), (bits, "bits"))]) for c in "ab")

    def run(batches):
        for batch in batches:
            keep = [may_be_similar(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(4, 8)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "row_a", "row_b"]).filter(pa.array(keep, pa.bool_()))

    found = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "row_a", "row_b", "bits_a", "bits_b", "size_a", "size_b")
    return found.mapInArrow(in_tasks(run), "a long, b long, row_a long, row_b long")


def _compared(pairs: DataFrame, docs: DataFrame, name: str, tables: Tables) -> DataFrame:
    """The pairs (a, b) of (a, b, row_a, row_b) whose whole sets are similar."""
    nodes = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("row_a").alias("row")), F.struct(F.col("b").alias("node"), F.col("row_b").alias("row")))).alias("x"))
    rows = tables.written(nodes.select("x.*").distinct(), f"rows_{name}")
    texts = tables.written(docs.join(checked(rows), "row").select("node", "text"), f"texts_{name}")
    one, two = texts.toDF("a", "one"), texts.toDF("b", "two")

    def run(batches):
        last, known = None, None
        for batch in (p for b in batches for p in sliced(b, 3)):
            one, two = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            keep = []
            for x, y in zip(one, two):
                if x != last:
                    last, known = x, shingles(x or b"")
                keep.append(similar(known, shingles(y or b"")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = small_batches(pairs.select("a", "b")).join(two, "b").join(one, "a").select("a", "b", "one", "two")
    return tables.written(full.mapInArrow(in_tasks(run), "a long, b long"), name)


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, name: str, tables: Tables) -> DataFrame:
    """Edges that connect what the pairs of nodes with similar whole sets connect; `sets` has one row a node, `pairs` is written.

    First each node is compared with one other, then only pairs that this has not put into one component.
    """
    nodes = tables.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"nodes_{name}")
    pairs = tables.written(_likely(pairs, sets.join(checked(nodes), "node"), "signature"), f"likely_{name}")
    first = pairs.groupBy("b").agg(F.min(F.struct("a", "row_a", "row_b")).alias("x"))
    first = tables.written(first.select("x.a", "b", "x.row_a", "x.row_b"), f"first_{name}")
    edges = _compared(first, docs, f"{name}1", tables)
    roots = components(edges, tables)
    one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    rest = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "row_a", "row_b")
    return edges.unionByName(_compared(tables.written(rest, f"rest_{name}"), docs, f"{name}2", tables))


def _by_fingerprint(single: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """Edges of similar sets among those whose SimHash fingerprints lie close together: a spanning forest's links, compared in full."""
    prints = tables.written(single.groupBy("fp").agg(F.min(F.struct("node", "row")).alias("x")).select("fp", "x.*"), "prints")
    spanning = tables.written(links(prints.select("fp"), tables.written), "spanning")
    one, two = (prints.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}"), F.col("row").alias(f"row_{c}")) for c in "ab")
    apart = spanning.join(one, "a").join(two, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "row_a", "row_b")
    first = prints.select(F.col("fp").alias("of"), F.col("node").alias("a"), F.col("row").alias("row_a"))
    equal = single.join(first, F.col("fp") == F.col("of")).where("node <> a").select("a", F.col("node").alias("b"), "row_a", F.col("row").alias("row_b"))
    return _compared(tables.written(apart.unionByName(equal), "close"), docs, "close_links", tables)


def near_copies(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Rows (row, text, ...) to (row, ..., component): equal for all rows that links of similar sets connect.

    `row` must name each row and stay the same when `docs` is read again. What the result reads is left in `tables`.
    """
    tables = tables or Tables()
    others = list(tables.held)
    sets = tables.written(_sets(docs), "sets")
    firsts = tables.written(sets.groupBy("node").agg(F.min("row").alias("row")), "firsts")
    single = sets.join(checked(firsts.select("row")), "row")  # one row a node
    edges = _by_fingerprint(single, docs, tables)
    rooted = lambda rows: rows.join(components(edges, tables).withColumnsRenamed({"node": "of", "root": "top"}), F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("top", "node"))
    met = rooted(single.select("node", "size", F.posexplode("first").alias("at", "key"))).select("key", "node", "size", "at", "root")
    near = _candidates(met, tables)
    hinted = tables.written(_likely(near.where("b is not null"), single, "brief"), "hinted")
    edges = edges.unionByName(_confirmed(hinted, single, docs, "links", tables))
    buckets = near.where("b is null").select(F.col("a").alias("key"), "n")
    if not buckets.isEmpty():
        large = tables.written(met.select("key", "node", "size").join(checked(buckets), "key"), "large")
        for best in (True, False):  # with the likeliest set of another component first, then with all that are still open
            more = _open_pairs(rooted(large), single, best, f"open_{'best' if best else 'all'}", tables)
            if more.isEmpty():
                break
            edges = edges.unionByName(_confirmed(more, single, docs, f"more_{'best' if best else 'all'}", tables))
    roots = tables.written(components(edges, tables).withColumnsRenamed({"node": "of", "root": "component"}), "roots")
    tables.keep(*others, sets, roots)
    return sets.join(roots, F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node")).drop("node", "size", "first", "signature", "brief", "fp", "of")


def brute_force(texts: list[str | None]) -> list[int]:
    """For each text the first that it is connected to, by comparing all pairs as sets of words; for tests."""
    def own(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))} if w else set()

    sets, up = [own(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]
