"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in at most 3 bits, and their components.

1. Fingerprints: XXH64 (seed 42) of each 3-word shingle, majority of each bit. One pass, written as a table.
2. Fingerprints that differ in at most 3 bits agree on one of 4 blocks of 16 bits, so each distinct fingerprint
   goes to 4 buckets. A bucket of more than `LIMIT` rows is cut finer by the same argument on the bits that are
   left (12, then 9 bits); one that is still larger is dealt into parts, and each pair of parts meets once.
3. In a task the rows' bits lie as 64 vertical planes. For a fingerprint and a word of 64 candidates the planes
   are added up in carry-save counters (ones, twos, over three); words whose candidates have all exceeded the
   radius are abandoned. Of the links a spanning forest per bucket is enough for the components.
4. Components by smallest-label rounds with shortcuts, each round written to the shared folder.
5. Components go back to the rows by a join on the fingerprint, whose plain shuffles let Spark split a fingerprint that
   many rows have (adaptive skew joins).

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows and equal
fingerprints are one class; a null id is never a component's name unless all ids of it are null; columns other
than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import Tables, appended, in_tasks, table, written

SHINGLE, SEED, RADIUS = 3, 42, 3
LIMIT = 4096
LEVELS = (16, 12, 9)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # on bytes: A-Z only, and space with 0x09-0x0D
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - 2)
    return majority(hashes)


def fingerprints(docs: DataFrame, text: str = "text", drop: bool = True) -> DataFrame:
    """`docs` plus `fp`, the fingerprint as a signed long."""

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            found = [fingerprint(t or b"") for t in column.cast(pa.binary()).to_pylist()]
            return [pa.array(np.array(found, np.uint64).view(np.int64))]

        return run

    return appended(docs, text, [("fp", T.LongType())], make, drop)


def close_pairs(keys: np.ndarray, prints: np.ndarray, chunk: int = 1 << 15):
    """Index pairs of rows with equal key (rows are sorted by it) and fingerprints within the radius."""
    n = len(keys)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    width = -(-n // 64)
    planes = np.zeros((64, width * 8), np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits, axis=0, bitorder="little").T
    planes = planes.view(np.uint64)
    ends = np.searchsorted(keys, keys, "right")
    rows = np.flatnonzero(np.arange(n) + 1 < ends)
    first, last = (rows + 1) // 64, (ends[rows] - 1) // 64
    counts = last - first + 1
    total = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, int(total[-1]), chunk):
        b = min(a + chunk, int(total[-1]))
        entry = np.arange(a, b)
        which = np.searchsorted(total, entry, "right") - 1
        row, word = rows[which], first[which] + entry - total[which]
        low = np.clip(row + 1 - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(64 - (ends[row] - word * 64), 0, 63).astype(np.uint64)
        over = ~((_ALL << low) & (_ALL >> high))  # other keys, and pairs met from the other side
        ones, twos = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
        for k in range(64):
            differ = planes[k, word] ^ (np.uint64(0) - bits[row, k].astype(np.uint64))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if k % 8 == 7:
                alive = over != _ALL
                if not alive.all():
                    row, word, ones, twos, over = row[alive], word[alive], ones[alive], twos[alive], over[alive]
                if not len(row):
                    break
        if len(row):
            at, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield row[at], word[at] * 64 + lane


def forest(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """For each row the first row of its bucket that it is linked to, over any number of links."""
    label = np.arange(len(keys))
    for i, j in close_pairs(keys, prints):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _forests(batches):
    """Rows (key, fp), sorted by key and never a key in two tasks, to edges (a, b) of fingerprints."""
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def edges(k, f):
        if not len(k):
            return
        root = forest(k, f.view(np.uint64))
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(f[moved]), pa.array(f[root[moved]])], names=["a", "b"])

    for batch in batches:
        k = np.concatenate([rest_k, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False)])
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        yield from edges(k[:cut], f[:cut])
        rest_k, rest_f = k[cut:], f[cut:]
    yield from edges(rest_k, rest_f)


def _finer(rows: DataFrame, level: int) -> DataFrame:
    """Rows (key, rest, fp) to four rows each, with one more block of `rest` in the key."""
    width = LEVELS[level]
    low = lambda n: (1 << n) - 1
    part = lambda i: F.struct(
        F.xxhash64("key", F.lit(i), F.shiftrightunsigned("rest", width * i).bitwiseAND(F.lit(low(width)))).alias("key"),
        F.shiftleft(F.shiftrightunsigned("rest", width * (i + 1)) if width * (i + 1) < 64 else F.lit(0).cast("long"), width * i).bitwiseOR(F.col("rest").bitwiseAND(F.lit(low(width * i)))).alias("rest"),
    )
    return rows.select("fp", F.explode(F.array(*[part(i) for i in range(4)])).alias("x")).select("x.key", "x.rest", "fp")


def links(prints: DataFrame, written: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Edges (a, b) of distinct fingerprints `fp` that span all links within the radius; `written` writes tables between steps."""
    rows = prints.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp")
    ready = []
    for level in range(len(LEVELS)):
        rows = _finer(rows, level)
        # Written, so that the join reads plain shuffles, whose hot keys Spark can split.
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{level}")
        rows = rows.join(sizes, "key")
        ready.append(rows.where(F.col("size") <= LIMIT).select("key", "fp"))
        rows = written(rows.where(F.col("size") > LIMIT), f"hot{level}")
        if rows.isEmpty():
            break
    else:
        parts = F.ceil(F.col("size") / LIMIT).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        ready.append(rows.select(F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other")).alias("key"), "fp"))
    out = None
    for part in ready:
        found = part.repartition("key").sortWithinPartitions("key").mapInArrow(in_tasks(_forests), "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, root) of the nodes of `edges` (a, b); the root is the component's smallest node.

    A round's tables are deleted once the next are written. Those of the last round are among `tables`, where these are given.
    """
    own = Tables()
    written = own.written
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels0")
    step = 0
    while True:
        step += 1
        near = written(both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near")), f"near{step}")
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        hooked = written(hooked, f"hooked{step}")
        up = hooked.select(F.col("node").alias("up"), F.col("root").alias("above"))
        labels = written(hooked.join(up, F.col("root") == F.col("up")).select("node", F.col("above").alias("root"), (F.col("above") < F.col("old")).alias("moved")), f"labels{step}")
        own.keep(both, labels)
        if labels.where("moved").isEmpty():
            own.keep(labels)
            if tables:
                tables.held.append(labels)
            return labels.select("node", "root")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id that is reachable over links of at most 3 bits."""
    prints = written(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text"), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    classes = written(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    names = written(classes.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    classes = classes.join(names, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id), "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """The same by comparing all pairs; for tests."""
    prints = {i: fingerprint((t or "").encode()) for i, t in rows}
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (prints[i] ^ prints[j]).bit_count() <= RADIUS and (a := root(i)) != (b := root(j)):
                up[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}
