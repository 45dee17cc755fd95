"""URL filter by a sorted digest array.

A rule is (host, path, verdict). Its key is the XXH64 of "host" + "path"; the index keeps all keys in one
sorted uint64 array, in a file that every task maps into memory, beside the full strings. A URL's candidate
keys (each host suffix with each path prefix whose length occurs among the rules) are probed in one
vectorised binary search, and a hit counts only if the stored string is the same.

Defined cases: a null URL or one without "://" has empty host and path, which only a rule of empty host and path fits; a
rule of empty host fits empty hosts and those that end in a dot; of
several rules the longest string wins, then the longer host; repeated rules count once (block before
allow); an empty rule table allows all; other columns of the page table pass through unless a result
column has their name. Of more than `max_index_rules`
rules each part has a sorted digest array of its own, to which the candidate strings are dealt by hash.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import in_tasks, without, written

#: The production rules (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
MAX_INDEX_RULES = 500_000

_HOST = r"^(?s).*?://([^/?#]*)"
_PATH = r"^(?s).*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url):
    """Columns (host, path) of a URL column."""
    host = F.translate(F.regexp_extract(url, _HOST, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def write_index(rules: list[tuple[str, str, str]]) -> str:
    """Writes the index file: sorted keys, then offsets, host lengths, verdicts and strings. Returns its path."""
    best: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        best[host, path] = "block" if "block" in (verdict, best.get((host, path))) else verdict
    rows = sorted((xxhash.xxh64_intdigest((h + p).encode(), 0), len(h), (h + p).encode(), v == "block") for (h, p), v in best.items())
    n = len(rows)
    offsets = np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int64)
    paths = sorted({len(r[2].decode()) - r[1] for r in rows})
    parts = [
        np.array([n, len(paths)], np.int64).tobytes(), np.array(paths, np.int64).tobytes(), np.array([r[0] for r in rows], np.uint64).tobytes(), offsets.tobytes(),
        np.array([r[1] for r in rows], np.int64).tobytes(), np.array([r[3] for r in rows], np.int64).tobytes(), b"".join(r[2] for r in rows),
    ]
    body = b"".join(parts)
    path = os.path.join(tempfile.gettempdir(), f"tidemark-url-{hashlib.sha256(body).hexdigest()[:24]}.idx")  # a file's name may be shipped from one place only
    with open(f"{path}.{os.getpid()}", "wb") as out:
        out.write(body)
    os.replace(out.name, path)
    return path


class DigestIndex:
    """The index file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k = raw[:16].view(np.int64)
        at = 16

        def take(count, kind=np.int64):
            nonlocal at
            out = raw[at : at + 8 * count].view(kind)
            at += 8 * count
            return out

        self.path_lengths = take(k).tolist()
        self.keys, self.offsets, self.host_chars, self.block = take(n, np.uint64), take(n + 1), take(n), take(n)
        self.strings = raw[at:]

    def string(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """Rule and verdict of each (host, path); rule None where no rule fits."""
        owner, strings, lengths = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for suffix in (host, *(host[j + 1 :] for j, c in enumerate(host) if c == ".")):
                for k in self.path_lengths:
                    if k <= len(path):
                        owner.append(i)
                        strings.append((suffix + path[:k]).encode())
                        lengths.append(len(suffix))
        best: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(hosts)
        if strings and len(self.keys):
            probes = np.fromiter((xxhash.xxh64_intdigest(s, 0) for s in strings), np.uint64, len(strings))
            at = np.searchsorted(self.keys, probes)
            for j in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probes).tolist():
                i = int(at[j])
                while i < len(self.keys) and self.keys[i] == probes[j]:
                    if self.host_chars[i] == lengths[j] and self.string(i) == strings[j]:
                        best[owner[j]] = max(best[owner[j]], (len(strings[j].decode()), lengths[j], i))
                    i += 1
        found = [(None, DEFAULT) if b[2] < 0 else (self.string(b[2]).decode(), "block" if self.block[b[2]] else "allow") for b in best]
        return [x for x, _ in found], [x for _, x in found]


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], url: str = "url", max_index_rules: int = MAX_INDEX_RULES) -> DataFrame:
    """`pages` with host, path, rule and verdict; `rules` has columns host, path, verdict."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    source = pages.select(*[f"`{c}`" for c in without(pages.columns, "host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    if not isinstance(rules, list):
        rules = rules.select("host", "path", "verdict").where("host is not null and path is not null")
        n_rules = rules.count()
        if n_rules > max_index_rules:
            return _parted(source, rules, n_rules, max_index_rules)
        rules = [tuple(r) for r in rules.collect()]
    file = write_index(rules)
    spark.sparkContext.addFile(file)
    name = os.path.basename(file)
    schema = T.StructType([*source.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches):
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            n = batch.num_columns
            rule, verdict = index.judge(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=schema.names)

    return source.mapInArrow(in_tasks(run), schema)


def _looked_up(batches):
    """Rows (part, string, host_chars, block), a part's rules before its probes (block null), to the probes that are rules."""
    part, rules, keys, order = None, [], None, None
    digests = lambda strings: np.fromiter((xxhash.xxh64_intdigest(s, 0) for s in strings), np.uint64, len(strings))
    for batch in batches:
        numbers, probe = np.asarray(batch.column(0)), np.asarray(batch.column(3).is_null())
        cuts = (np.flatnonzero((numbers[1:] != numbers[:-1]) | (probe[1:] != probe[:-1])) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a == b:
                continue
            if numbers[a] != part:
                part, rules, keys = numbers[a], [], None
            rows = list(zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in (1, 2, 3))))
            if not probe[a]:
                rules += rows
                continue
            if keys is None:  # the part's sorted digest array
                keys = digests([s for s, _, _ in rules])
                order = np.argsort(keys)
                keys = keys[order]
            found = digests([s for s, _, _ in rows])
            low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
            hits = [rules[order[i]] for j in np.flatnonzero(low < high).tolist() for i in range(low[j], high[j]) if rules[order[i]][:2] == rows[j][:2]]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.string(), pa.int32(), pa.bool_()))], names=["string", "host_chars", "block"])


def _parted(source: DataFrame, rules: DataFrame, n_rules: int, part_rules: int) -> DataFrame:
    """For rule tables too large for one file: strings are dealt by hash, and each part has a sorted digest array of its own."""
    parts = -(-n_rules // max(1, part_rules))
    rules = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
    lengths = F.broadcast(rules.agg(F.sort_array(F.collect_set(F.length("path"))).alias("__lengths")))  # one row
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sites = source.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).crossJoin(lengths)
    sites = sites.withColumn("k", F.explode("__lengths")).where(F.col("k") <= F.length("path")).drop("__lengths")
    sites = written(sites.select("host", "path", F.concat("suffix", F.expr("substring(path, 1, k)")).alias("string"), F.length("suffix").alias("host_chars")), "probes")
    own = rules.select(F.concat("host", "path").alias("string"), F.length("host").alias("host_chars"), "block")
    both = own.unionByName(sites.select("string", "host_chars").distinct().withColumn("block", F.lit(None).cast("boolean")))
    both = both.select(F.pmod(F.xxhash64("string"), F.lit(parts)).alias("part"), "string", "host_chars", "block").repartition("part").sortWithinPartitions("part", F.desc_nulls_last("block"))
    hits = both.mapInArrow(in_tasks(_looked_up), "string string, host_chars int, block boolean")
    order = F.struct(F.length("string").alias("n"), "host_chars", "string", "block")
    best = sites.join(hits, ["string", "host_chars"]).groupBy("host", "path").agg(F.max(order).alias("__best"))
    out = source.join(best, ["host", "path"], "left")
    block = F.coalesce(F.col("__best.block"), F.lit(DEFAULT == "block"))
    return out.withColumn("rule", F.col("__best.string")).withColumn("verdict", F.when(block, "block").otherwise("allow")).drop("__best").select(*source.columns, "rule", "verdict")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages.select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC) AS k
  FROM parts LEFT JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.r_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT DISTINCT host, path, rule, r_verdict FROM fits WHERE k = 1) f ON p.host = f.host AND p.path = f.path
"""
