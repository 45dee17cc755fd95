"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words. Each sliding window of WINDOW k-grams (K words each) keeps its
smallest k-gram hash, all of equal ones. Two texts that share K + WINDOW - 1 = 10 words share a kept
fingerprint, so every shared span of 10 words is met when documents' and items' fingerprints are joined.

1. Fingerprints of all items, and of all documents, are joined by Spark. If the items have few enough, tasks look
   them up first, so that only what can meet leaves a task; that choice changes the work, not the result.
2. What a document's fingerprint met is extended to the windows of 10 words around it. These are joined with the
   items' windows on the words themselves, so no hash decides. Items of fewer words are one window of that many.
3. A document's hit words are the union of its windows that some item has; its items are counted apart from where
   they hit, so neither repeated words nor repeated items multiply.

Documents are told apart by two 64-bit hashes of their texts, so equal texts are looked at as one.

Defined cases: null and empty texts have no words and no hits; items without words hit nothing; repeated items
count each by its own id, a null item id is ignored; other columns pass through unless they have a result's name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import CHECKED_ROWS, SLICE_BYTES, in_tasks, sliced, small_batches, table, text_bytes, without, written

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of a slice of texts: their bytes, hashes and texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = _WORD[self.data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True  # a text's end is the next one's beginning
        self.starts = np.flatnonzero(word[1:] & (~word[:-1] | first))
        self.ends = np.flatnonzero(word[:-1] & (~word[1:] | first))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.power(_ODD, n), out=total[1:])
        self.hash = mixed((total[self.ends] - total[self.starts]) * self.power(_INVERSE, n + 1)[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.bounds = np.searchsorted(self.starts, offsets)

    _tables: dict[int, np.ndarray] = {}

    @classmethod
    def power(cls, base: int, n: int) -> np.ndarray:
        known = cls._tables.get(base)
        if known is None or len(known) < n:
            known = cls._tables[base] = powers(base, max(n, SLICE_BYTES + (1 << 18)))
        return known[:n]

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on; all ones where the text ends before."""
        n = len(self.hash)
        out = np.full(n, _LAST)
        if n >= k:
            p = powers(0xD6E8FEB86659FD93, k)
            h = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                h += self.hash[j : n - k + 1 + j] * p[j]
            out[: n - k + 1] = np.where(self.text[k - 1 :] == self.text[: n - k + 1], h, _LAST)
        return out

    def bytes(self, a: int, b: int) -> bytes:
        """The words from a up to b, joined."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the kept K-grams."""
        gram = self.grams(K)
        n = len(gram)
        padded = np.concatenate([gram, np.full(WINDOW - 1, _LAST)])
        low = padded[:n].copy()
        for j in range(1, WINDOW):
            np.minimum(low, padded[j : n + j], out=low)
        kept = np.zeros(n + WINDOW - 1, bool)
        for j in range(WINDOW):
            kept[j : n + j] |= padded[j : n + j] == low
        at = np.flatnonzero(kept[:n] & (gram != _LAST))
        return at, gram[at]


def _item_windows(batches):
    """Rows (id, text) to the windows (id, n, gram) of items; an item of fewer words than SPAN is one."""
    for part in (p for batch in batches for p in sliced(batch, 1, SLICE_BYTES // 4)):
        words = Words(*text_bytes(part.column(1)))
        of, sizes, grams = [], [], []
        for i, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
            if n := min(SPAN, b - a):
                found = {words.bytes(k, k + n) for k in range(a, b - n + 1)}
                of += [i] * len(found)
                sizes += [n] * len(found)
                grams += found
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), pa.array(sizes, pa.int32()), pa.array(grams, pa.binary())], names=["id", "n", "gram"])


def _prints(words: Words, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, words, hash): kept fingerprints, and all grams of the given fewer words."""
    at, found = words.winnowed()
    parts = [(at, np.full(len(at), SPAN, np.int32), found)]
    for n in short:
        gram = words.grams(n)
        at = np.flatnonzero(gram != _LAST)
        parts.append((at, np.full(len(at), n, np.int32), gram[at]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _item_prints(batches, short):
    """Rows (id, text) to the prints (n, hash) of items; those of SPAN words have fingerprints."""
    for part in (p for batch in batches for p in sliced(batch, 1)):
        words = Words(*text_bytes(part.column(1)))
        size = np.minimum(np.diff(words.bounds), SPAN)
        at, n, found = _prints(words, short)
        own = size[words.text[at]] == n
        yield pa.RecordBatch.from_arrays([pa.array(n[own]), pa.array(found[own].view(np.int64))], names=["n", "hash"])


def _doc_prints(batches, short, known):
    """Rows (text, t1, t2) to (t1, t2, n, hash, at), without those not in `known` where that is given."""
    for part in (p for batch in batches for p in sliced(batch, 0)):
        words = Words(*text_bytes(part.column(0)))
        at, n, found = _prints(words, short)
        if known is not None:
            held = known.value
            place = np.minimum(np.searchsorted(held, found), len(held) - 1) if len(held) else np.zeros(len(found), np.int64)
            keep = held[place] == found if len(held) else np.zeros(len(found), bool)
            at, n, found = at[keep], n[keep], found[keep]
        text = words.text[at]
        row = pa.array(text)
        yield pa.RecordBatch.from_arrays([part.column(1).take(row), part.column(2).take(row), pa.array(n), pa.array(found.view(np.int64)), pa.array((at - words.bounds[text]).astype(np.int32))], names=["t1", "t2", "n", "hash", "at"])


def _around(batches):
    """Rows (text, t1, t2, met: array of (n, at)) to the windows (t1, t2, n, s, gram) that have what was met."""
    for part in (p for batch in batches for p in sliced(batch, 0, SLICE_BYTES // 4)):
        words = Words(*text_bytes(part.column(0)))
        of, sizes, starts, grams = [], [], [], []
        for i, met in enumerate(part.column(3).to_pylist()):
            first, total = int(words.bounds[i]), int(words.bounds[i + 1] - words.bounds[i])
            places = {(m["n"], s) for m in met for s in (range(max(0, m["at"] - SPAN + K), m["at"] + 1) if m["n"] == SPAN else (m["at"],))}
            for n, s in sorted(places):
                if s + n <= total:
                    of.append(i)
                    sizes.append(n)
                    starts.append(s)
                    grams.append(words.bytes(first + s, first + s + n))
        row = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(1).take(row), part.column(2).take(row), pa.array(sizes, pa.int32()), pa.array(starts, pa.int32()), pa.array(grams, pa.binary())], names=["t1", "t2", "n", "s", "gram"])


FIELDS = [("n_words", T.LongType()), ("hit_spans", T.ArrayType(T.IntegerType())), ("items", T.ArrayType(T.StringType())), ("n_hit", T.LongType())]


def found_in(keyed: DataFrame, items: DataFrame, checked_prints: int = CHECKED_ROWS) -> DataFrame:
    """(t1, t2, hit_spans, n_hit, items) of the texts (text, t1, t2) that have a window of an item (id, text)."""
    spark = keyed.sparkSession
    own = written(small_batches(items).mapInArrow(in_tasks(_item_windows), "id string, n int, gram binary"), "item_windows")
    short = sorted(r["n"] for r in own.select("n").distinct().where(F.col("n") < SPAN).collect())  # at most nine numbers
    prints = written(items.mapInArrow(in_tasks(lambda b: _item_prints(b, short)), "n int, hash long").distinct(), "item_prints")
    known = None
    if prints.count() <= checked_prints:
        known = spark.sparkContext.broadcast(np.sort(prints.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64)))
    met = keyed.mapInArrow(in_tasks(lambda b: _doc_prints(b, short, known)), "t1 long, t2 long, n int, hash long, at int")
    met = met.join(prints, ["n", "hash"]).groupBy("t1", "t2").agg(F.collect_set(F.struct("n", "at")).alias("met"))
    met = written(met, "met")
    windows = keyed.join(met, ["t1", "t2"]).select("text", "t1", "t2", "met").mapInArrow(in_tasks(_around), "t1 long, t2 long, n int, s int, gram binary")
    grams = own.select("n", "gram").distinct()
    hits = written(windows.distinct().join(grams, ["n", "gram"]), "hits")
    # Where: the union of the hit windows.
    order = Window.partitionBy("t1", "t2").orderBy("s", "n")
    end = F.col("s") + F.col("n")
    steps = hits.select("t1", "t2", "s", "n", end.alias("e"), F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    steps = steps.withColumn("run", F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(order))
    runs = steps.groupBy("t1", "t2", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    where = runs.groupBy("t1", "t2").agg(F.sum(F.col("e") - F.col("s")).alias("n_hit"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("s", "e"))), lambda x: F.array(x["s"], x["e"]))).alias("hit_spans"))
    which = hits.select("t1", "t2", "n", "gram").distinct().join(own, ["n", "gram"]).groupBy("t1", "t2").agg(F.sort_array(F.collect_set("id")).alias("items"))
    return written(where.join(which, ["t1", "t2"]), "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", drop: bool = False, checked_prints: int = CHECKED_ROWS) -> DataFrame:
    """`docs` plus n_words, hit_spans (from, to, from, to, ... in words), items (ids, sorted) and n_hit.

    `checked_prints`: up to so many fingerprints of items are looked up in tasks before the join.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    one, two = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    keyed = small_batches(docs).select(F.col(text).alias("text"), one.alias("t1"), two.alias("t2")).where("text is not null")
    found = found_in(keyed, items, checked_prints).select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("hit_spans").alias("__spans"), F.col("n_hit").alias("__hit"), F.col("items").alias("__items"))
    kept = [F.col(f"`{c}`") for c in without(docs.columns, *dict(FIELDS)) if not (drop and c == text)]
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.select(*kept, words.alias("n_words"), one.alias("__k1"), two.alias("__k2"), F.col(text).isNotNull().alias("__some"))
    out = out.join(found, F.col("__some") & (F.col("__k1") == F.col("__t1")) & (F.col("__k2") == F.col("__t2")), "left")
    none = {n: F.array().cast(t) for n, t in FIELDS if isinstance(t, T.ArrayType)}
    found_columns = [F.coalesce("__spans", none["hit_spans"]).alias("hit_spans"), F.coalesce("__items", none["items"]).alias("items"), F.coalesce("__hit", F.lit(0)).cast("long").alias("n_hit")]
    return out.select(*kept, "n_words", *found_columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), drop=True)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, int, str, bool]:
    """The same by comparing every window with every position; for tests."""
    import re

    def words(s):
        s = "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)

    doc, hit, ids = words(text), set(), []
    for i, t in items:
        item = words(t)
        n = min(SPAN, len(item))
        windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if n else set()
        at = [p for p in range(len(doc) - n + 1) if n and tuple(doc[p : p + n]) in windows]
        hit.update(x for p in at for x in range(p, p + n))
        ids += [str(i)] * bool(at)
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least({SPAN}, len(w)) AS n, array_to_string(list_slice(w, k, k + least({SPAN}, len(w)) - 1), ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - {SPAN} + 1, 1) + 1)) t(k) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) t(k)),
hits AS (SELECT DISTINCT doc_id, item_id, k, dw.n AS n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
