"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
#: Whether Spark removes a query's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a session in one process (as in tests) gets a temporary folder; on a
    cluster, whose executors would not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="passagelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A private folder below the shared one, for the tables of one operator call; removed when the session ends.

    With ``free`` a table that is written lets go of the shuffle files it was made from, which nothing reads again.
    """

    def __init__(self, spark: SparkSession, name: str, free: bool = False):
        self.spark, self.free = spark, free
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        fs.deleteOnExit(root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: what follows no longer depends on how it was made."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true" if self.free else before)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes that a Python task is handed at once.  A longer single text makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def slim(docs: DataFrame, *extra: str) -> DataFrame:
    """``(id, text)``: ids as long, a null id as the smallest long, a null text as the empty one.

    Bounds the session's Arrow batches, which otherwise hold 10,000 whole texts (see :func:`bound_batches`).
    """
    bound_batches(docs.sparkSession)
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        *[docs[c] for c in extra],
    )


def real_id(name: str = "id"):
    """The id column as the caller knows it."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def part_count(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces_of(spark: SparkSession, n_bytes: int, each: int = 64 << 20) -> int:
    """Pieces of at most about ``each`` bytes, which one Python task holds at a time; the session's shuffle partitions at least."""
    return max(part_count(spark), -(-n_bytes // each))


def parts_by_size(texts: DataFrame, part_bytes: int) -> int:
    """Pieces of about ``part_bytes`` that the texts of ``(id, text)`` make up: one number, counted over all rows."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, -(-total // part_bytes))


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that gives memory back as a task ends: its worker stays, idle, beside those of the next stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` for applyInArrow that gives memory back after each group."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return wrapped
