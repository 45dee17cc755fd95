"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of `docs`, whatever they are named.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import decontaminate, language_id, near_copies, pieces, repeats
from tidemark.llm.base import CHECKED_ROWS, Tables

PASSAGE = 51  # words
MODEL = "piece_bpe_32k.model"
OWN = ("doc_id", "text", "lang")


def beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` on docs whose other columns have names that meet no result's; the columns of `docs` come back."""
    names = [c if c in OWN else f"__doc_{i}" for i, c in enumerate(docs.columns)]
    out = work(docs.toDF(*names)).select(*[f"`{n}`" for n in names])
    return out.toDF(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models of all labelled documents reject go: no letter, or no such language."""
    model = language_id.train(docs)
    return beside(docs, lambda d: language_id.identify(d, model, prefix="__found_").where("not __found_rejected"))


def content_hash(content: list[str], salt: int) -> Column:
    return F.xxhash64(*[F.lit(-salt)] * (salt > 0), *content)


def told_apart(docs: DataFrame, tables: Tables) -> tuple[DataFrame, list[DataFrame]]:
    """Each different row of `docs` once, with a hash of its content that no other has as __k1; and the tables that this reads.

    So rows have names without a copy of the texts. Only rows that come more than once are written; all, if that are many.
    """
    content = ["text", *[f"`{f.name}`" for f in docs.schema if isinstance(f.dataType, T.AtomicType)]]
    for salt in itertools.count():  # another one if two different rows have one hash
        named = docs.withColumn("__k1", content_hash(content, salt))
        sums = named.withColumn("k2", F.xxhash64(F.lit(1), *content)).groupBy("__k1").agg(F.count("*").alias("n"), F.min("k2").alias("low"), F.max("k2").alias("high"))
        again = tables.written(sums.where("n > 1"), "again")
        if again.where("low < high").isEmpty():
            break
    n = again.count()
    if not n:
        return named, []
    if n > CHECKED_ROWS:
        once = tables.written(named.dropDuplicates(["__k1"]), "once")
        return once, [once]
    same = F.broadcast(again.select("__k1"))
    once = tables.written(named.join(same, "__k1", "left_semi").dropDuplicates(["__k1"]), "once")
    return named.join(same, "__k1", "left_anti").unionByName(once), [again, once]


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of a Jaccard similarity of 0.8 or more (5-word shingles) connect one row stays: that of the smallest doc_id.

    Rows are told apart by hashes of their content, so documents of one doc_id, or of none, are compared like any others.
    A null doc_id comes last; rows of one doc_id are ordered by such a hash. SimHash fingerprints find the first links.
    """
    def work(d: DataFrame) -> DataFrame:
        tables = Tables()
        named, read = told_apart(d, tables)
        found = near_copies.near_copies(named.select(F.col("__k1").alias("row"), "text", F.col("doc_id").alias("id")), tables)
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
        kept = tables.written(found.groupBy("component").agg(least.alias("x")).select(F.col("x.row").alias("__k1")), "kept")
        tables.keep(kept, *read)
        return named.join(kept, "__k1", "left_semi").drop("__k1")

    return beside(docs, work)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes, that also start elsewhere go from the texts; a text of which nothing is left goes."""
    def work(d: DataFrame) -> DataFrame:
        out = repeats.remove_repeats(d, as_text=True, words=PASSAGE)
        return out.where((F.size("removed_spans") == 0) | (F.trim("kept_text") != "")).withColumn("text", F.when(F.size("removed_spans") == 0, F.col("text")).otherwise(F.col("kept_text")))

    out = beside(docs, work)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark's window of 10 words go, and those of which shorter items make up half the words or more."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    long = f"exists(filter(hit_spans, (x, i) -> i % 2 = 1 and x - hit_spans[i - 1] >= {decontaminate.SPAN}), x -> true)"
    return beside(docs, lambda d: decontaminate.decontaminate(d, items).where(f"not ({long} or n_hit > 0 and 2 * n_hit >= n_words)"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text, whose decoding is the text."""
    out = pieces.encode_samples(docs.select("doc_id", "text"), public_tokenizers.path(MODEL), "doc_id")
    return out.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "ids", "log_prob", "inclusion", "round_trip")


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: SQL cannot say the language models and the sampled lattice paths; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables()
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), name)
        tables.keep(docs)  # the stage before is not read again
    return STAGES[-1][1](spark, docs, sf_dir)
