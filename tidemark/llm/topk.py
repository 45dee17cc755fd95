"""Exact top-k inner-product search with a bit-sliced index.

The rows of a block are kept as vertical bit slices: for each dimension, slice j holds bit j of every row's
quantised component. For a query, slices (complemented where its component is negative) are added with
carry-save adders at the weights of the query's bits, which leaves the slices of the quantised scores of all
rows. The k best are selected from the most significant slice downward. Every row that the quantisation error
leaves in doubt is then scored exactly, so the result is exact.

Rows are dealt to blocks of at most about `BLOCK_BYTES` of components by a hash, each row once. A block's rows come to one
task, which makes their index, and then the queries, which stream through it. So what is shuffled is the rows, and the
queries once for each block, with components of as few bytes as the table's largest needs. Equal vectors are one row of the index with its k + 1 smallest ids.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no
part; a table whose scores could leave the range of a long is refused; shorter vectors count as ended by zeros; equal rows count once; ties go to the smaller id; fewer than k
candidates give all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import in_tasks, table, written

BLOCK_BYTES, LEAST, SLICES = 64 << 20, 32_768, 7  # fewer rows than LEAST a block, and calls on slices cost more than the slices


def integer_vectors(rows: DataFrame, id: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * component) of the usable vectors."""
    usable = rows.where(F.col(id).isNotNull() & F.col(vector).isNotNull())
    usable = usable.where(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return usable.select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def widest(column: pa.Array) -> int:
    return int(np.asarray(column.value_lengths()).max(initial=0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    offsets, counts = offsets - offsets[0], np.diff(offsets)
    out = np.zeros((len(counts), width), values.dtype)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(values)) - offsets[:-1][row]] = values
    return out


class SlicedIndex:
    """Bit slices of a block of integer vectors."""

    def __init__(self, vectors: np.ndarray, slices: int = SLICES):
        self.vectors = vectors
        n, self.dims = vectors.shape
        self.low = vectors.min(axis=0).astype(np.int64) if n else np.zeros(self.dims, np.int64)
        span = int((vectors.max(axis=0).astype(np.int64) - self.low).max(initial=0)) if n else 0
        self.shift = max(0, span.bit_length() - slices)
        self.slices = min(slices, max(1, span.bit_length()))
        self.words = -(-n // 64)
        planes = np.zeros((self.dims, self.slices, self.words * 8), np.uint8)
        for d in range(0, self.dims, 32):  # some dimensions at a time, so that wide copies stay small
            codes = (vectors[:, d : d + 32].astype(np.int64) - self.low[d : d + 32]) >> self.shift
            for j in range(self.slices):
                planes[d : d + 32, j, : -(-n // 8)] = np.packbits((codes >> j & 1).astype(np.uint8), axis=0, bitorder="little").T
        self.planes = planes.view(np.uint64)
        self.real = np.zeros(self.words * 8, np.uint8)
        self.real[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.real = self.real.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum |q_d| * t_d, least significant first; t_d is the code of the row, complemented for q_d < 0."""
        columns: list[list[np.ndarray]] = []
        for d in np.flatnonzero(query).tolist():
            source, weight = self.planes[d] if query[d] > 0 else ~self.planes[d], abs(int(query[d]))
            for b in range(weight.bit_length()):
                if weight >> b & 1:
                    while len(columns) < b + self.slices:
                        columns.append([])
                    for j in range(self.slices):
                        columns[b + j].append(source[j])
        out, at = [], 0
        while at < len(columns):
            own = columns[at]
            if at + 1 == len(columns) and len(own) > 1:
                columns.append([])
            while len(own) > 2:
                x, y, z = own.pop(), own.pop(), own.pop()
                half = x ^ y
                columns[at + 1].append((x & y) | (half & z))
                own.insert(0, half ^ z)
            if len(own) == 2:
                columns[at + 1].append(own[0] & own[1])
                own[:] = [own[0] ^ own[1]]
            out.append(own[0] if own else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def in_doubt(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best."""
        if len(self.vectors) <= k:
            return np.arange(len(self.vectors))
        scores = self.score_slices(query)
        sure, equal, kth = np.zeros(self.words, np.uint64), self.real.copy(), 0
        for b in range(len(scores) - 1, -1, -1):
            trial = sure | (equal & scores[b])
            n = int(np.bitwise_count(trial).sum())
            if n >= k:
                equal &= scores[b]
                kth |= 1 << b
            else:
                sure = trial
                equal &= ~scores[b]
        width = ((1 << self.shift) - 1) * int(np.abs(query).sum())
        least = max(0, kth - -(-width >> self.shift) - 1)
        over, equal = np.zeros(self.words, np.uint64), self.real.copy()
        for b in range(len(scores) - 1, -1, -1):
            if least >> b & 1:
                equal &= scores[b]
            else:
                over |= equal & scores[b]
                equal &= ~scores[b]
        return np.flatnonzero(np.unpackbits((over | equal).view(np.uint8), bitorder="little"))


class Block:
    """The index of a block's rows; `v` are their vectors, `ids` the ids of each."""

    def __init__(self, v: pa.Array, ids: pa.Array):
        self.index = SlicedIndex(matrix(v, widest(v)))
        self.ids, self.offsets = ids.flatten().to_numpy(zero_copy_only=False), np.asarray(ids.offsets)
        self.offsets = self.offsets - self.offsets[0]
        self.least = self.ids[self.offsets[:-1]]

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own."""
        at = self.index.in_doubt(query, k + 1)
        score = self.index.vectors[at].astype(np.int64) @ query
        best = np.lexsort((self.least[at], -score))[: k + 1]
        at, score = at[best], score[best]
        member = np.concatenate([self.ids[self.offsets[i] : self.offsets[i + 1]] for i in at.tolist()]) if len(at) else np.empty(0, np.int64)
        score = np.repeat(score, self.offsets[at + 1] - self.offsets[at])
        keep = member != own
        member, score = member[keep], score[keep]
        best = np.lexsort((member, -score))[:k]
        return member[best], score[best]


def _searched(k: int):
    """Rows (block, id, ids, v), a block's rows (without id) before its queries (without ids), to (query_id, vec_id, score)."""

    def run(batches):
        held, block, number = [], None, None
        for batch in batches:
            blocks, is_query = np.asarray(batch.column(0)), np.asarray(batch.column(1).is_valid())
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if number != blocks[a]:
                    held, block, number = [], None, blocks[a]
                if not is_query[a]:
                    held.append(part)
                    continue
                if block is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    block, held = Block(rows.column("v").combine_chunks(), rows.column("ids").combine_chunks()), []
                if block is None:
                    continue
                ids, vectors = part.column(1).to_pylist(), part.column(3)
                width = block.index.dims
                queries = matrix(vectors, max(width, widest(vectors)))[:, :width].astype(np.int64)
                found = [block.search(own, query, k) for own, query in zip(ids, queries)]
                n = [len(m) for m, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.concatenate([m for m, _ in found]).astype(np.int64)), pa.array(np.concatenate([s for _, s in found]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, is_query, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `is_query` (on column id) holds, its k best other rows."""
    vectors = integer_vectors(rows, id, vector)
    # Ranges by doubles, which cannot wrap; one row.
    sized = rows.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector)).alias("dims"), F.max(F.array_max(F.transform(F.filter(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    dims, most = max(1, sized["dims"] or 1), int(1024 * (sized["most"] or 0)) + 1
    if dims * most * most >= 1 << 63:
        raise ValueError(f"scores of {dims} components up to {most} leave the range of a long")
    kind, size = next((kind, size) for kind, size in (("smallint", 2), ("int", 4), ("bigint", 8)) if most < 1 << (8 * size - 1))
    vectors = written(vectors.withColumn("v", F.col("v").cast(f"array<{kind}>")), "vectors")
    block = max(64, BLOCK_BYTES // (dims * size))
    first = Window.partitionBy("v").orderBy("id")
    distinct = vectors.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = written(distinct.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    queries = written(vectors.where(is_query(F.col("id"))).distinct(), "queries")
    n, least = distinct.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // block), min(least, -(-n // LEAST)))
    left = distinct.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), F.lit(None).cast("long").alias("id"), "ids", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), "id", F.lit(None).cast("array<long>").alias("ids"), "v")
    met = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", F.asc_nulls_first("id"))
    found = met.mapInArrow(in_tasks(_searched(k)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda id: id % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
