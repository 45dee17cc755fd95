"""Repeated passages: every byte covered by a 400-byte string that also starts elsewhere is removed.

1. Windows of `SPAN` bytes are named by the smallest hash of a `GRAM`-byte gram inside them (leftmost of equal
   ones), which depends on the window alone. Consecutive windows of one name are a piece. Windows of a piece
   share a core of over 200 bytes around the gram; equal windows have equal cores, so they meet under the key
   of the core. Pieces whose key occurs once hold nothing repeated and go.
2. Pieces whose whole contexts are equal repeat as a whole. They are the inside of the runs below.
3. Different contexts under one key go to a run-length index: suffixes in order, Burrows-Wheeler transform,
   its runs with their ends sampled. Only at run ends a common prefix is measured on the bytes; inside a run it
   is one less than that of the position before. So the matching statistics of each context against all others
   are streamed from the samples, and window starts with a match of 400 bytes or more are marked.
4. A key of more than `LIMIT` different contexts is cut finer: windows are told apart by where the gram lies in them,
   in parts half as wide, which lengthens the core, and steps 2 and 3 are taken again under the new keys. The last
   core is a window, under which there is one context. So no task gets more than `LIMIT` contexts of one key.
5. Marks go back to all texts with such a piece, and the covered bytes out of the texts.

Keys and contexts are XXH3 hashes of their bytes under different seeds, 128 bits together; the sums from which the
grams' hashes come only choose names.

Defined cases: null and empty texts have no bytes; a text shorter than 400 bytes loses nothing; texts are told
apart by two 64-bit hashes, copies share their marks; other columns pass through unless they have a result's name.

Passages by words: with `words` the same steps also run over each text as a string of codes, 5 bytes of hash for each
word between white space, with a span of so many codes; marks at word starts take the words from first to last. White
space between the words may differ. Words of one code differ once in 2**40 pairs.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import Tables, in_tasks, sliced, small_batches, table, text_bytes, without, written

SPAN, GRAM = 400, 32
CODE = 5
PASSAGE = 51  # words
LIMIT = 256
SEGMENT = 250_000
CHUNK = 250_000
PLACE_BITS = 24

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker."""
    out = _tables.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _tables[base] = out
    return out[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of any substrings of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, n), out=self.total[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def __call__(self, a, b) -> np.ndarray:
        return mixed((self.total[b] - self.total[a]) * self.inverse[a])


def window_names(hasher: Hasher, n: int, span: int = SPAN) -> np.ndarray:
    """For each start of `span` bytes, the place of the smallest gram inside."""
    window = span - GRAM + 1
    m = n - GRAM + 1
    gram = hasher(slice(0, m), slice(GRAM, n + 1))
    low = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(m, dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: m - window + 1], low[window - width :])
    return (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def digests(data: np.ndarray, a: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH3 of the bytes from each a up to b, as signed longs."""
    view = memoryview(np.ascontiguousarray(data))
    found = (xxhash.xxh3_64_intdigest(view[x:y], s) for x, y, s in zip(a.tolist(), b.tolist(), seeds.tolist()))
    return np.fromiter(found, np.uint64, len(a)).view(np.int64)


def part_widths(span: int) -> list[int]:
    """How many places of the gram in its window one key stands for, level by level."""
    out = [(span - GRAM + 1) // 2 + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def named(data: np.ndarray, first: np.ndarray, last: np.ndarray, gram: np.ndarray, width: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and context of runs of window starts, from first to last, that have one gram in one part of so many places."""
    part = (gram - first) // width
    low = part * width
    high = np.minimum(low + width, span - GRAM + 1) - 1
    key = digests(data, gram - low, gram - high + span, (part << 10) + width)
    return key, digests(data, first, last + span, np.full(len(first), 1 << 20))


def pieces(data: np.ndarray, offsets: np.ndarray, span: int = SPAN):
    """(text, from, to, key, context) of all pieces; from and to are the first and last window start in the text."""
    width = part_widths(span)[0]
    for s in range(0, max(0, len(data) - span + 1), SEGMENT):
        part = data[s : s + SEGMENT + span - 1]
        if len(part) < span:
            continue
        hasher = Hasher(part)
        name = window_names(hasher, len(part), span)
        starts = np.arange(len(name))
        text = np.searchsorted(offsets, starts + s, "right") - 1
        real = starts + s + span <= offsets[1:][text]
        far = (name - starts) // width
        cut = (name[1:] != name[:-1]) | (far[1:] != far[:-1]) | (text[1:] != text[:-1])
        a = np.flatnonzero(real & np.concatenate([[True], cut | ~real[:-1]]))
        b = np.flatnonzero(real & np.concatenate([cut | ~real[1:], [True]]))
        text = text[a]
        key, context = named(part, a, b, name[a], width, span)
        yield text, a + s - offsets[text], b + s - offsets[text], key, context


def _strings(column: pa.Array, coded: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and their offsets; with `coded` those of the word codes."""
    data, offsets = text_bytes(column)
    if not coded:
        return data, offsets
    starts, ends = word_bounds(data, offsets)
    codes = mixed(Hasher(data)(starts, ends) + (ends - starts).astype(np.uint64))
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, :CODE]).ravel(), np.searchsorted(starts, offsets) * CODE


def _pieces(batches, span, coded):
    for batch in batches:
        for part in sliced(batch, 0, SEGMENT):
            one, two = part.column(1), part.column(2)
            for text, a, b, key, context in pieces(*_strings(part.column(0), coded), span):
                text = pa.array(text)
                yield pa.RecordBatch.from_arrays([one.take(text), two.take(text), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(key), pa.array(context)], names=["t1", "t2", "a", "b", "key", "context"])


class RunLengthIndex:
    """Run-length Burrows-Wheeler index of some strings, with the suffix places sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        n = len(self.data)
        owner = np.repeat(np.arange(len(strings)), self.sizes + 1)
        self.ends = (self.begins + self.sizes)[owner]
        self.order = self._suffixes(n, int(self.sizes.max(initial=0)))
        before = self.data[self.order - 1].astype(np.int16)
        first = np.zeros(n, bool)
        first[self.begins] = True
        before[first[self.order]] = -1  # the beginning of a string goes on with no other
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0)
        self.heads = np.flatnonzero(head)  # first suffix of each run; the one before it is the last of the run above

    def _suffixes(self, n: int, longest: int) -> np.ndarray:
        """Places of all suffixes in order, by doubling; each suffix ends with its string.

        Up to a million places a word and its place are sorted as one number, which is much faster than their order.
        """
        place, bits = np.arange(n, dtype=np.uint64), n.bit_length()
        left = self.ends - place.astype(np.int64)

        def ordered(word, size):
            if size + bits > 64:
                order = np.argsort(word)
                return order, word[order]
            both = np.sort(word << np.uint64(bits) | place)
            return (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)

        width = 5
        word = np.zeros(n, np.uint64)
        for i in range(width):  # five bytes and how many are real, so that an end comes before any byte
            byte = np.zeros(n, np.uint64)
            byte[: n - i] = self.data[i:]
            word |= np.where(left > i, byte, 0).astype(np.uint64) << np.uint64(8 * (width - 1 - i) + 3)
        order, found = ordered(word | np.minimum(left, width).astype(np.uint64), 43)
        while True:
            new = np.concatenate([[False], found[1:] != found[:-1]])
            if width > longest or new.sum() == n - 1:
                return order
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
            rest = np.zeros(n, np.uint64)
            inside = np.flatnonzero(left > width)
            rest[inside] = rank[inside + width]
            order, found = ordered(rank << np.uint64(bits) | rest, 2 * bits)
            width *= 2

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and at y."""
        out, most = np.zeros(len(x), np.int64), np.minimum(self.ends[x] - x, self.ends[y] - y)
        live = np.flatnonzero(most > 0)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        words = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # at each place the eight bytes from there on
        while len(live):
            at = out[live]
            differ = words[x[live] + at] ^ words[y[live] + at]
            low = np.bitwise_count(~differ & (differ - np.uint64(1))) >> 3  # equal bytes before the first that differs
            out[live] = np.minimum(at + low, most[live])
            live = live[(differ == 0) & (out[live] < most[live])]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place the longest match of its suffix with one at another place."""
        n = len(self.data)
        best = np.zeros(n, np.int64)
        heads = self.heads[self.heads > 0]
        sample = self.common(self.order[heads - 1], self.order[heads])
        for known, first in ((self.order[heads], self.order[0]), (self.order[heads - 1], self.order[n - 1])):
            value, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
            value[known], at[known] = sample, known
            at[first] = first
            at = np.maximum.accumulate(at)
            best = np.maximum(best, value[at] - (np.arange(n) - at))
        return best

    def repeated(self, span: int = SPAN) -> list[tuple[int, int, int]]:
        """(string, from, to): runs of starts of `span` bytes that also start elsewhere."""
        long = np.concatenate([[False], self.matching_statistics() >= span, [False]])
        edges = np.flatnonzero(long[1:] != long[:-1])
        string = np.searchsorted(self.begins, edges[::2], "right") - 1
        return [(k, a - int(self.begins[k]), b - 1 - int(self.begins[k])) for k, a, b in zip(string.tolist(), edges[::2].tolist(), edges[1::2].tolist())]


def _resolve(batches, span):
    """Rows (key, context, bytes), sorted by key and no key in two tasks, to marks (context, key, from, to)."""
    held, size, last = [], 0, None

    def marks():
        if len(held) < 2:
            return
        found = RunLengthIndex([h[2] for h in held]).repeated(span)
        yield pa.RecordBatch.from_arrays([pa.array([held[k][1] for k, _, _ in found], pa.int64()), pa.array([held[k][0] for k, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], names=["context", "key", "s", "e"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if size > CHUNK and row[0] != last:
                yield from marks()
                held, size = [], 0
            held.append(row)
            size += len(row[2])
            last = row[0]
    yield from marks()


def _contexts(batches, span, coded):
    """Rows (text, spans: array of (key, context, a, b, size)) to (key, context, size, data)."""
    for batch in batches:
        for part in sliced(batch, 0, SEGMENT):
            data, offsets = _strings(part.column(0), coded)
            spans = part.column(1)
            row = np.repeat(np.arange(len(spans)), np.asarray(spans.value_lengths()))
            flat = spans.flatten()
            begin = offsets[row] + flat.field("a").to_numpy()
            end = offsets[row] + flat.field("b").to_numpy() + span
            view = memoryview(np.ascontiguousarray(data))
            found = pa.array([bytes(view[x:y]) for x, y in zip(begin.tolist(), end.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("context"), flat.field("size"), found], names=["key", "context", "size", "data"])


def _finer(batches, span, level):
    """Rows (key, context, data) of contexts to their parts at a level: (k0, c0, shift, last, key, context, data)."""
    width = part_widths(span)[level]
    for batch in batches:
        for part in sliced(batch, 2, SEGMENT):
            data, offsets = text_bytes(part.column(2))
            name = window_names(Hasher(data), len(data), span)
            starts = np.arange(len(name))
            row = np.searchsorted(offsets, starts, "right") - 1
            real = starts + span <= offsets[1:][row]
            place = (name - starts) // width
            cut = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            a = np.flatnonzero(real & np.concatenate([[True], cut | ~real[:-1]]))
            b = np.flatnonzero(real & np.concatenate([cut | ~real[1:], [True]]))
            row = row[a]
            key, context = named(data, a, b, name[a], width, span)
            view = memoryview(np.ascontiguousarray(data))
            inside = pa.array([bytes(view[x : y + span]) for x, y in zip(a.tolist(), b.tolist())], pa.binary())
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array((a - offsets[row]).astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(key), pa.array(context), inside], names=["k0", "c0", "shift", "last", "key", "context", "data"])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in texts that lie one after the other; space and 0x09-0x0D are between words."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's end is the next one's beginning
    return np.flatnonzero(word[1:] & (~word[:-1] | first)), np.flatnonzero(word[:-1] & (~word[1:] | first))


def _many(rows: DataFrame) -> DataFrame:
    """`rows`, to be dealt by key to so many tasks that each has some thousand contexts."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, rows.count() // 4096), "key")


def _marks(data: DataFrame, span: int, tables: Tables, level: int = 0) -> DataFrame:
    """(context, key, s, e): marked window starts of contexts (key, context, size, data); size counts those of the key."""
    usual = _many(data.where(F.col("size") <= LIMIT).select("key", "context", "data")).sortWithinPartitions("key", "context")
    marks = usual.mapInArrow(in_tasks(partial(_resolve, span=span)), "context long, key long, s int, e int")
    hot = data.where(F.col("size") > LIMIT).select("key", "context", "data")
    if level + 1 == len(part_widths(span)) or hot.isEmpty():
        return marks
    parts = hot.mapInArrow(in_tasks(partial(_finer, span=span, level=level + 1)), "k0 long, c0 long, shift int, last int, key long, context long, data binary")
    parts = tables.written(parts, f"parts{level + 1}")
    counts = tables.written(parts.groupBy("key", "context").agg(F.count("*").alias("n")), f"counts{level + 1}")
    sizes = tables.written(counts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{level + 1}")
    own = parts.select(F.col("c0").alias("context"), F.col("k0").alias("key"), F.col("shift").alias("s"), (F.col("shift") + F.col("last")).alias("e"), F.struct("key", "context").alias("part"))
    named_part = lambda df: df.withColumn("part", F.struct("key", "context"))
    whole = own.join(named_part(counts.where("n > 1")).select("part"), "part").drop("part")
    deeper = tables.written(_marks(tables.written(parts.dropDuplicates(["key", "context"]).join(sizes, "key").select("key", "context", "size", "data"), f"data{level + 1}"), span, tables, level + 1), f"marks{level + 1}")
    deeper = named_part(deeper.join(counts.where("n = 1").drop("n"), ["key", "context"])).select("part", F.col("s").alias("from"), F.col("e").alias("to"))
    deeper = own.join(deeper, "part").select("context", "key", (F.col("s") + F.col("from")).alias("s"), (F.col("s") + F.col("to")).alias("e"))
    return marks.unionByName(whole).unionByName(deeper)


def marked_spans(docs: DataFrame, text: str = "text", span: int = SPAN, coded: bool = False) -> DataFrame:
    """(t1, t2, spans): for each text with repeated passages its marked window starts, as arrays (from, to).

    With `coded` the span and the starts count bytes of word codes.
    """
    keyed = small_batches(docs).select(F.col(text).alias("text"), *text_hashes(text)).where(F.octet_length("text") >= (2 * span // CODE - 1 if coded else span))
    tables = Tables()
    every = tables.written(keyed.mapInArrow(in_tasks(partial(_pieces, span=span, coded=coded)), "t1 long, t2 long, a int, b int, key long, context long"), "pieces")
    # Sums are written before they are joined, so that the join reads plain shuffles, whose hot keys Spark can split.
    keys = tables.written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    kept = tables.written(every.join(keys, "key"), "kept")
    tables.keep(kept)
    contexts = kept.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "a", "b")).alias("at"))
    contexts = tables.written(contexts, "contexts")
    buckets = tables.written(contexts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = contexts.join(buckets, "key").select("at.t1", "at.t2", F.struct("key", "context", "at.a", "at.b", "size").alias("span"))
    members = tables.written(members.groupBy("t1", "t2").agg(F.collect_list("span").alias("spans")), "members")
    data = keyed.join(members, ["t1", "t2"]).select("text", "spans").mapInArrow(in_tasks(partial(_contexts, span=span, coded=coded)), "key long, context long, size long, data binary")
    data = tables.written(data.dropDuplicates(["key", "context"]), "data")
    marks = _marks(data, span, tables)
    whole = contexts.where("n > 1").select("context", "key", F.lit(0).alias("s"), (F.col("at.b") - F.col("at.a")).alias("e"))
    single = contexts.where("n = 1").select("context", "key")
    marks = tables.written(whole.unionByName(marks.join(single, ["context", "key"]).select(*whole.columns)), "marks")
    spans = kept.join(marks, ["context", "key"]).select("t1", "t2", F.struct((F.col("a") + F.col("s")).alias("from"), (F.col("a") + F.col("e")).alias("to")).alias("span"))
    spans = tables.written(spans.distinct().groupBy("t1", "t2").agg(F.collect_list("span").alias("spans")), "spans")
    tables.keep(spans)
    return spans


def text_hashes(text: str):
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2")


def word_ranges(spans: list[dict] | None, words: int | None) -> list[tuple[int, int]]:
    """Maximal ranges of words that marked starts of `words` word codes cover."""
    found = ((-(-s["from"] // CODE), s["to"] // CODE) for s in spans or [])
    return cover([(a, b + words) for a, b in found if a <= b])


def cover(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", as_text: bool = False, words: int | None = None, cut_words: bool = True) -> DataFrame:
    """`docs` plus removed_spans (byte ranges, flat) and kept_bytes, what is left of the text.

    With `as_text` there is kept_text instead; characters that a range cuts in two go from it as a whole.
    With `words` passage_spans holds the ranges, counted in words, of repeated passages of so many words, whatever
    their bytes; with `cut_words` they are removed as well.
    """
    kept_name = "kept_text" if as_text else "kept_bytes"
    added = [("passage_spans", T.ArrayType(T.IntegerType()))] * bool(words) + [("removed_spans", T.ArrayType(T.IntegerType())), (kept_name, T.StringType() if as_text else T.BinaryType())]
    source = docs.select(*[f"`{c}`" for c in without(docs.columns, *dict(added))])
    n = len(source.columns)
    spans = marked_spans(docs, text).withColumn("words", F.lit(None).cast("array<struct<from:int,to:int>>"))
    if words:
        more = marked_spans(docs, text, words * CODE, True).select("t1", "t2", F.lit(None).cast("array<struct<from:int,to:int>>").alias("spans"), F.col("spans").alias("words"))
        spans = spans.unionByName(more).groupBy("t1", "t2").agg(F.first("spans", True).alias("spans"), F.first("words", True).alias("words"))
        spans = written(spans, "all_spans")
    spans = spans.toDF("__t1", "__t2", "__spans", "__words")
    one, two = text_hashes(text)
    joined = source.withColumns({"__k1": one, "__k2": two}).join(spans, (F.col("__k1") == F.col("__t1")) & (F.col("__k2") == F.col("__t2")), "left")
    joined = joined.select(*[f"`{c}`" for c in source.columns], "__spans", "__words")
    at = source.columns.index(text)
    schema = T.StructType([*source.schema.fields, *(T.StructField(*f) for f in added)])

    def run(batches):
        for part in (p for batch in batches for p in sliced(batch, at)):
            removed, kept, passages = [], [], []
            for s, marks, more in zip(*(part.column(i).to_pylist() for i in (at, n, n + 1))):
                data = (s or "").encode()
                ranges, by_words = [(m["from"], m["to"] + SPAN) for m in marks or []], word_ranges(more, words)
                passages.append([x for r in by_words for x in r])
                if by_words and cut_words:
                    starts, ends = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    ranges += [(int(starts[a]), int(ends[b - 1])) for a, b in by_words]
                removed.append([x for r in cover(ranges) for x in r])
                ends = [0, *removed[-1], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
            left = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            lists = [pa.array(x, pa.list_(pa.int32())) for x in ([passages] * bool(words) + [removed])]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *lists, left], names=schema.names)

    return joined.mapInArrow(in_tasks(run), schema)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: words in passages of over 50 words that also start elsewhere; by bytes alone they stay."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), words=PASSAGE, cut_words=False)
    size, left = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"), F.octet_length("kept_bytes")
    passages = F.aggregate("passage_spans", F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-1).cast("bigint").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")))["sum"]
    return out.select(
        "doc_id", size.alias("n_bytes"), (size - left).alias("n_removed"), (F.size("removed_spans") / 2).cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"), passages.alias("n_passage_words"),
    )


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h,
                  regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
win AS (SELECT r, s, md5(b[s + 1 : s + {SPAN}]) AS x FROM d, unnest(range(0, greatest(octet_length(b) - {SPAN - 1}, 0))) t(s)),
starts AS (SELECT r, s FROM win WHERE x IN (SELECT x FROM win GROUP BY x HAVING count(*) > 1)),
steps AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {SPAN} THEN 0 ELSE 1 END AS new FROM starts),
runs AS (SELECT r, min(s) AS a, max(s) + {SPAN} AS z FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM steps) GROUP BY r, k),
gaps AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM gaps JOIN d USING (r) GROUP BY r),
pw AS (SELECT r, k, md5(array_to_string(list_slice(w, k, k + {PASSAGE - 1}), ' ')) AS x FROM d, unnest(range(1, greatest(len(w) - {PASSAGE - 2}, 1))) t(k)),
pk AS (SELECT r, k FROM pw WHERE x IN (SELECT x FROM pw GROUP BY x HAVING count(*) > 1)),
pn AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + {PASSAGE})) AS p FROM pk) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN head IS NULL THEN b ELSE unhex(head || substr(h, 2 * tail + 1)) END) AS kept_sha256, coalesce(n, 0) AS n_passage_words
FROM d LEFT JOIN cut USING (r) LEFT JOIN pn USING (r)
"""


def brute_force(rows: list[tuple[int, str | None]], span: int = SPAN) -> dict[int, tuple[int, int, int, str]]:
    """The same by counting all strings of `span` bytes; for tests."""
    seen: dict[bytes, int] = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for data in texts.values():
        for k in range(len(data) - span + 1):
            seen[data[k : k + span]] = seen.get(data[k : k + span], 0) + 1
    out = {}
    for i, data in texts.items():
        gone = np.zeros(len(data) + 2, bool)
        for k in range(len(data) - span + 1):
            if seen[data[k : k + span]] > 1:
                gone[k + 1 : k + 1 + span] = True
        kept = bytes(b for b, g in zip(data, gone[1:-1]) if not g)
        out[i] = (len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out
