"""Periodic runs: stretches of a text's words that repeat with a period, and the texts without the repetitions.

A run is a stretch of words with smallest period q and at least `LEAST` and 2q words that no neighbouring word
extends. All texts of a slice are worked on side by side, as one array of word codes.

1. Splitting: a word of a run occurs in it twice at least, so one that its segment holds only once is in no run of the
   segment and splits it. What is left is counted again, segment by segment, until nothing splits; segments too short
   for a run go. Where many rounds cut little each, what is left is scanned as it is, with the same result.
2. Lags: short ones are compared throughout. A run of period q in [2k, 4k), k a power of two, holds a gram of k words
   that begins at a multiple of k and comes again q words later. So for each k such grams are looked up among the
   grams, whose names come by doubling (equal names, equal words), and each lag found is extended to both sides by the
   names of all lengths. Of one stretch the smallest lag is its period.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows are looked at
each by itself; a text of any length is taken whole; columns of the input pass through unless they have a result's name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import appended, table

LEAST = 12  # words of a run
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 64  # times that the words of a slice are counted, on average, before the rest is scanned as it is
SHORT = 8  # lags below are compared throughout
BLOCK = 1 << 18  # lags that are extended at once
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows, and the n + 1 offsets of the rows."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = parts.flatten()
    some = np.asarray(pc.binary_length(words)) > 0
    offsets = parts.offsets.to_numpy()
    kept = np.concatenate([[0], np.cumsum(some)])
    return words.filter(pa.array(some)), kept[offsets - offsets[0]]


def segments(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that are left after splitting, and their segment's number (ascending, with gaps)."""
    at = np.arange(len(code))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    done_at, done_of, next_of = [], [], len(offsets)
    budget = ROUNDS * len(code)
    while len(at):
        # Stretches of neighbouring positions of one segment are the segments of this round.
        first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(of) != 0)])
        of = np.cumsum(first) - 1
        size = np.bincount(of)
        long = size[of] >= LEAST
        at, of = at[long], of[long]
        if not len(at):
            break
        _, where, count = np.unique(of * (int(code.max()) + 1) + code[at], return_inverse=True, return_counts=True)
        once = count[where] == 1
        budget -= len(at)
        changed = np.zeros(int(of.max()) + 1, bool)
        changed[of[once]] = True
        stable = ~changed[of] if budget > 0 else np.ones(len(at), bool)
        done_at.append(at[stable])
        done_of.append(of[stable] + next_of)
        next_of += int(of.max()) + 1
        at, of = at[~stable & ~once], of[~stable & ~once]
    if not done_at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, of = np.concatenate(done_at), np.concatenate(done_of)
    order = np.argsort(at)
    return at[order], of[order]


def _names(code: np.ndarray) -> list[np.ndarray]:
    """For lengths 1, 2, 4, ... equal numbers for equal grams from each position on; -1 for grams that come once."""

    def named(key: np.ndarray, some: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, np.int32)
        if some.any():
            _, where, count = np.unique(key[some], return_inverse=True, return_counts=True)
            out[some] = np.where(count[where] > 1, where, -1)
        return out

    levels = [named(code, np.ones(len(code), bool))]
    while (levels[-1] >= 0).any():
        last, k = levels[-1], 1 << (len(levels) - 1)
        if len(last) <= k:
            break
        a, b = last[:-k].astype(np.int64), last[k:]
        levels.append(named(a << 32 | b, (a >= 0) & (b >= 0)))
    return levels


def _extended(levels: list[np.ndarray], i: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where the words equal those `lag` before or after them, around the gram of k words at i."""
    begin, end, n = i.copy(), i + k, len(levels[0])
    for j in range(len(levels) - 1, -1, -1):
        names, step = levels[j], 1 << j
        if len(names) != n - step + 1:
            continue
        ok = end + lag + step <= n
        here, there = names[np.where(ok, end, 0)], names[np.where(ok, end + lag, 0)]
        end += step * (ok & (here == there) & (here >= 0))
        ok = begin >= step
        here, there = names[np.where(ok, begin - step, 0)], names[np.where(ok, begin - step + lag, 0)]
        begin -= step * (ok & (here == there) & (here >= 0))
    return begin, end + lag


def _lags(names: np.ndarray, k: int, n: int):
    """(i, lag) in blocks: grams at multiples i of k that come again lag words later, 2k <= lag < 4k."""
    some = np.flatnonzero(names >= 0)
    key = names[some].astype(np.int64) * (n + 1) + some
    key.sort()
    anchors = some[some % k == 0]
    own = names[anchors].astype(np.int64) * (n + 1)
    low = np.searchsorted(key, own + np.minimum(anchors + 2 * k, n))
    high = np.searchsorted(key, own + np.minimum(anchors + 4 * k, n))
    met = np.flatnonzero(high > low)
    total = np.cumsum(high[met] - low[met])
    for a in range(0, len(met), BLOCK // (2 * k) + 1):  # an anchor meets 2k grams at most
        part = met[a : a + BLOCK // (2 * k) + 1]
        size = high[part] - low[part]
        start = total[a] - size[0]
        place = np.arange(size.sum()) - np.repeat(total[a : a + len(part)] - size - start, size) + np.repeat(low[part], size)
        i = np.repeat(anchors[part], size)
        yield i, key[place] % (n + 1) - i


def _scan(code: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of an array in which no run crosses a code that comes once."""
    n, found = len(code), []
    for lag in range(1, min(SHORT, n)):
        same = np.concatenate([[False], code[:-lag] == code[lag:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2] + lag
        found.append(np.stack([begin, end - begin, np.full(len(begin), lag)], 1))
    levels = _names(code)
    for j in range(2, len(levels)):
        k = 1 << j
        for i, lag in _lags(levels[j], k, n):
            begin, end = _extended(levels, i, lag, k)
            long = end - begin >= 2 * lag
            found.append(np.unique(np.stack([begin[long], end[long] - begin[long], lag[long]], 1), axis=0))
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[(runs[:, 1] >= LEAST) & (runs[:, 1] >= 2 * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):  # of one stretch the smallest lag
        runs = runs[np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts as word codes the runs (start, length, period), by text, start and period, and each run's text."""
    at, of = segments(code, offsets)
    if not len(at):
        return np.empty((0, 3), np.int64), np.empty(0, np.int64)
    # One array, with a code of its own between segments.
    gap = np.concatenate([[0], np.cumsum(np.diff(of) != 0)])
    place = np.arange(len(at)) + gap
    joined = np.full(int(place[-1]) + 1, -1, np.int64)
    joined[place] = code[at]
    between = joined < 0
    joined[between] = int(code.max()) + 1 + np.arange(between.sum())
    word = np.zeros(len(joined), np.int64)
    word[place] = at
    runs = _scan(joined)
    runs[:, 0] = word[runs[:, 0]]
    text = np.searchsorted(offsets, runs[:, 0], "right") - 1
    runs[:, 0] -= offsets[text]
    return runs, text


def _make():
    def run(column: pa.Array) -> list[pa.Array]:
        words, offsets = words_of(column)
        code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        runs, text = runs_of(code, offsets)
        change = np.zeros(len(code) + 1, np.int64)
        np.add.at(change, offsets[text] + runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, offsets[text] + runs[:, 0] + runs[:, 1], -1)
        keep = np.cumsum(change[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), pa.scalar(" ", words.type))
        rows = pa.StructArray.from_arrays([pa.array(runs[:, c].copy()) for c in range(3)], names=RUN.names)
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(column)))]).astype(np.int32)
        return [pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows), collapsed.cast(pa.string())]

    return run


def periodic_runs(docs: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    """`docs` plus n_words, runs (start, length, period: by start, then period) and collapsed_text.

    The collapsed text has, joined by one space, the words that no run holds after its first period.
    """
    return appended(docs, text, [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("collapsed_text", T.StringType())], _make, drop)


def planted(id: Column, text: Column) -> Column:
    """The text; where crc32 of the id ends in 0, its words from the a-th on repeat with a period p.

    With g the crc32 without its last digit, a is g modulo the words and p about a third to a tenth of the rest.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    h = F.crc32(id.cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))

    def period(parts: Column) -> Column:
        w, first, length = parts["w"], parts["a"], parts["p"]
        moved = lambda i: (F.when(i < first, i).otherwise(first + (i - first) % length)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 1), lambda i: F.get(w, moved(i))), " ")

    parts = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    return F.when((h % 10 == 0) & (n > 0), F.get(F.transform(F.array(parts), period), F.lit(0))).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs(docs, drop=True)
    # The greatest length; of equal ones the smallest start, then period.
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    out = out.withColumn("longest", longest)
    length = -F.col("longest.less")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), F.col("longest.period").alias("period"),
        F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def brute_force(words: list) -> tuple[list[tuple[int, int, int]], list]:
    """Runs and kept words by comparing all words at all lags; for tests."""
    n, runs = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(LEAST, 2 * q):
                runs.setdefault((i, j + q - i), q)
            i = j + 1
    found = sorted((s, m, q) for (s, m), q in runs.items())
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return sorted(found, key=lambda r: (r[0], r[2])), [w for i, w in enumerate(words) if i not in gone]


def brute_row(doc_id: int | None, text: str | None) -> dict:
    """A row of the query; for tests."""
    import re
    import zlib

    words = re.findall(WORD, text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, kept = brute_force(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if runs else None,
        "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), "collapsed_sha256": sha(" ".join(kept)),
    }
