"""Shared helpers: tables written to the shared folder, appended columns, text slices for numpy."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1_000_000
BATCH_ROWS = 1_000  # rows of an Arrow batch, unless the session says otherwise than Spark's default
CHECKED_ROWS = 500_000  # rows of two longs that may be broadcast: about 40 MB as a hash table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_tasks(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; at its end the worker, which lives on, gives the memory back that it does not use."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return task


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session takes fewer rows to a Python worker at once: texts are long."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def checked(df: DataFrame) -> DataFrame:
    """A written table of a few longs a row, marked for broadcast if its rows are few enough; else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= CHECKED_ROWS else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset a local one of a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = at
    return out


class Tables:
    """The written tables of one call, to be deleted as soon as no later step reads them."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(written(df, name))
        return self.held[-1]

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all others; what is still read from them must have been written."""
        for t in self.held:
            if not any(t is k for k in tables):
                t._written_at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(t._written_at, True)
        self.held = [t for t in self.held if any(t is k for k in tables)]


def sliced(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes + 8) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def without(columns: list[str], *names: str) -> list[str]:
    """The columns that none of the names, in whatever case, takes the place of."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def free(columns: list[str], name: str) -> str:
    """The name, or where a column has it a longer one."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def appended(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], drop: bool = False) -> DataFrame:
    """`df` (without `column` if `drop`) plus `fields`, computed from the text column in Arrow batches.

    `make` runs once a task and returns the function on a slice of the column. A column of `df` that
    has the name of a new field is replaced.
    """
    kept = [c for c in without(df.columns, *(n for n, _ in fields)) if not (drop and c == column)]
    source = df.select(*[f"`{c}`" for c in kept], df[column].alias(free(kept, "__text")))
    schema = T.StructType([f for f in source.schema.fields[:-1]] + [T.StructField(n, t) for n, t in fields])

    def run(batches):
        function = make()
        for batch in batches:
            for part in sliced(batch, batch.num_columns - 1):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *function(part.column(part.num_columns - 1))], names=schema.names)

    return small_batches(source).mapInArrow(in_tasks(run), schema)
