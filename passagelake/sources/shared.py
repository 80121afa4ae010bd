"""The folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which a claim without a published file, or data that none names, is a dead writer's.
LEASE = 600


class Conflict(RuntimeError):
    """Another writer was faster."""


def _claim(fs, path) -> None:
    """Create a file that must not exist.  Hadoop's local file system looks first and creates then, so there the system's own call is made."""
    if fs.getScheme() != "file":
        fs.create(path, False).close()
        return
    fs.mkdirs(path.getParent())
    os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))


def publish(fs, path_of, name: str, body: dict) -> None:
    """Put a JSON file in place, whole, if no other writer has published or claimed ``name``; a claim that outlived ``LEASE`` is taken over."""
    to, claim = path_of(f"{name}.json"), path_of(f"{name}.claim")
    if not fs.exists(to) and fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > LEASE:
        fs.delete(claim, False)
    try:
        _claim(fs, claim)
    except Exception as e:
        raise Conflict(f"{name} was published, or claimed, by another writer") from e
    made = path_of(f"{name.rpartition('/')[0]}/_made-{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
    out.close()
    if not fs.rename(made, to):
        if fs.exists(to):  # a writer that took this one's claim over
            raise Conflict(f"{name} was published by another writer")
        raise RuntimeError(f"{name} could not be put in place")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only for a session in one process that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="passagelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written within lets go of the shuffle files it was made from, which nothing reads again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Folder:
    """A private folder below the shared one; its tables go when the session ends.  With ``free`` shuffle files go as each is written."""

    def __init__(self, spark: SparkSession, name: str, free: bool = False):
        self.spark, self.free, self.root = spark, free, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame, name: str, group: int = 128 << 20) -> DataFrame:
        """Write a table once, in row groups of about ``group`` bytes, and read it back."""
        rows = 100 if group >= 128 << 20 else 10  # so many are written before their bytes are counted
        with freeing(self.spark) if self.free else nullcontext():
            df.write.option("parquet.block.size", group).option("parquet.page.size.row.check.min", rows).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def holds(self, name: str) -> bool:
        """Whether a table is there, whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)


def spread(df: DataFrame) -> DataFrame:
    """A table whose files make fewer tasks than there are cores, dealt over these; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files below ``path``: another one once any of them is written anew."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = [], root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
