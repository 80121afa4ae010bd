"""Line dedup against levelled sorted runs of line hashes.

Documents are taken in batches of ascending id.  A batch's distinct line keys
are merge-anti-joined with the runs of earlier batches and calls; keys that no run holds
become a new sorted run of level 0, and ``FANOUT`` runs of a level are merged
into one of the next.  Runs are bucketed by hash: a join reads them as they lie, without an exchange.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, part_count, real_id, slim
from .textvec import arrow_texts

#: Runs of a level that are merged into one of the next.
FANOUT = 2
_SPACE = b" \t\n\x0b\x0c\r"
_HASH = np.dtype([("h1", np.int64), ("h2", np.int64)])


def _key(line: bytes, least: int) -> bytes | None:
    """128 bits of the line's key, or None for a key of under ``least`` code points."""
    key = line.strip(_SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, t in zip(batch.column("id").to_pylist(), arrow_texts(batch), strict=True):
                own = {k for k in (_key(x, least) for x in t.split(b"\n")) if k}
                found += own
                ids += [i] * len(own)
            h = np.frombuffer(b"".join(found), _HASH)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h["h1"]), pa.array(h["h2"])], names=["id", "h1", "h2"])

    return run


def _drop(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, dropped, kept = batch.column("id"), [], [], []
            for t, gone in zip(arrow_texts(batch), batch.column("gone").to_pylist(), strict=True):
                lines = t.split(b"\n")
                if gone:
                    keys = {np.array((x["h1"], x["h2"]), _HASH).tobytes() for x in gone}
                    left = [x for x in lines if _key(x, least) not in keys]
                else:
                    left = lines
                n.append(len(lines))
                dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_lines", "n_dropped", "kept"])

    return run


class LineRuns:
    """The line keys seen so far, ``(h1, h2)`` in runs bucketed and sorted by hash, below one folder.

    A run is a folder ``run-<level>-<number>``; it counts once its ``_SUCCESS`` file is there.  Opened on
    a folder that has runs, it goes on from them: keys of earlier calls are known.  A merge writes the
    new run before it removes the old ones; a key that is in two runs is as good as in one.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        old = [n for n in names if n.startswith("buckets-")]
        #: Buckets of every run: as many as when the folder was new, so that runs and batches meet without an exchange of the runs.
        self.buckets = int(old[0].rpartition("-")[2]) if old else buckets or part_count(spark)
        if not old:
            self._fs.mkdirs(self._path(f"{self.folder}/buckets-{self.buckets}"))
        runs = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("run-") and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        self.made = 1 + max((n for _, n in runs), default=-1)
        self.levels: list[list[tuple[int, str]]] = [[] for _ in range(1 + max((level for level, _ in runs), default=-1))]
        for level, n in sorted(runs):
            table = self._table()
            spark.sql(f"CREATE TABLE {table} (h1 BIGINT, h2 BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self._place(level, n)}'")
            self.levels[level].append((n, table))

    def _table(self) -> str:
        return f"line_run_{uuid.uuid4().hex}"

    def _place(self, level: int, n: int) -> str:
        return f"{self.folder}/run-{level}-{n}"

    def all(self) -> list[DataFrame]:
        return [self.spark.table(table) for level in self.levels for _, table in level]

    def unknown(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no run holds: one merge anti join with each run."""
        return reduce(lambda df, run: df.join(run.hint("merge"), ["h1", "h2"], "left_anti"), self.all(), keys)

    def known(self, keys: DataFrame) -> DataFrame:
        """The rows whose key a run holds."""
        found = [keys.join(run.hint("merge"), ["h1", "h2"], "left_semi") for run in self.all()]
        return reduce(DataFrame.unionAll, found) if found else keys.limit(0)

    def _write(self, df: DataFrame, level: int) -> None:
        n, table = self.made, self._table()
        self.made += 1
        dealt = df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        dealt.option("path", self._place(level, n)).option("compression", "zstd").saveAsTable(table)
        self.levels[level].append((n, table))

    def add(self, keys: DataFrame) -> None:
        """Add a run of new keys, then merge levels that are full."""
        level, full = 0, keys.select("h1", "h2")
        old: list[tuple[int, str]] = []
        while full is not None:
            if level == len(self.levels):
                self.levels.append([])
            self._write(full, level)
            for n, table in old:
                self.spark.sql(f"DROP TABLE {table}")
                self._fs.delete(self._path(self._place(level - 1, n)), True)
            full = None
            if len(self.levels[level]) == FANOUT:
                old, self.levels[level] = self.levels[level], []
                full = reduce(DataFrame.unionAll, [self.spark.table(t) for _, t in old]).distinct()
                level += 1

    def close(self) -> None:
        """Forget the tables; the runs stay in their folder."""
        for level in self.levels:
            for _, table in level:
                self.spark.sql(f"DROP TABLE {table}")
        self.levels = []


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Lets plans made inside rely on the order of runs, which have one sorted file a bucket."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_repeated_lines(docs: DataFrame, least: int = 10, batches: int = 4, digest: bool = False, runs: LineRuns | None = None) -> DataFrame:
    """Of each line found in several documents only the lines of the smallest document stay.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, in
    lower case for A-Z; keys of under ``least`` code points never match.  Returns
    ``doc_id, n_lines, n_dropped, kept`` (with ``digest``: ``kept_sha256``), one
    row for each input row.  A null or empty text is one empty line; a null id
    is smaller than all others; rows of one id count as one document; texts of any length are
    split whole; other columns are ignored, whatever their names; an empty table has no rows.  The
    result does not depend on ``batches``.  With ``runs`` lines known from earlier calls go from all documents, and
    this call's lines are added to them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    keys = scratch.keep(slim(docs).mapInArrow(_keys(least), "id long, h1 long, h2 long"), "keys")
    share = [k / batches for k in range(1, batches)]
    bounds = keys.agg(F.percentile_approx("id", share, 10_000)).first()[0] if share else []
    bounds = sorted(set(bounds or []))
    keeps, runs, late = runs is not None, runs or LineRuns(spark, scratch.path("runs")), []
    for k, (lo, hi) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        mine = keys
        if lo is not None:
            mine = mine.where(F.col("id") > lo)
        if hi is not None:
            mine = mine.where(F.col("id") <= hi)
        with _sorted_scans(spark):
            seen = mine.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"))
            seen = scratch.keep(seen, f"seen-{k}")
            new = scratch.keep(runs.unknown(seen), f"new-{k}")
            # Lines to drop in this batch: of new keys those after the first holder, of known ones all.
            late.append(new.where("low < high").select("h1", "h2", F.col("low").alias("first"), F.lit(False).alias("each")))
            late.append(scratch.keep(runs.known(seen).select("h1", "h2", F.lit(lo).cast("long").alias("first"), F.lit(lo is None).alias("each")), f"known-{k}"))
            if k < len(bounds) or keeps:
                runs.add(new)
    if not keeps:
        runs.close()
    # A key may be late in several batches: one row for each is left, with its first holder.
    late = reduce(DataFrame.unionAll, late).groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("each").alias("each"))
    gone = keys.join(late, ["h1", "h2"]).where("each or id > first").groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    text = slim(docs).join(gone, "id", "left").select("id", "text", "gone")
    out = text.mapInArrow(_drop(least), "id long, n_lines long, n_dropped long, kept binary")
    kept = F.sha2("kept", 256).alias("kept_sha256") if digest else F.col("kept")
    return out.select(real_id().alias("doc_id"), "n_lines", "n_dropped", kept)
