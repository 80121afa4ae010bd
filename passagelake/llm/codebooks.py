"""Vectors as short codes: each of a vector's parts becomes the index of its nearest entry in that part's codebook.

Codebooks are trained by Lloyd's rounds.  A block of vectors keeps, for each part position and entry, a heap of the parts
that the entry holds, keyed by the slack between a lower bound on the distance to every other entry and an upper bound on the
distance to its own.  A round adds to each entry's drift how far it moved and how far any other one did; parts whose
key the cumulative drift has passed are popped and scanned exactly, the others keep their entry unread.  A
heap lies as an ascending array, so what must be popped is its head.

Blocks are rows of a written table, a round is one pass over them, and only sums of the parts that changed entries
leave a task.  A codebook is ``parts * entries`` short vectors whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import treesum
from .scratch import Scratch, bound_batches, tidy

#: Scaled components beyond this are held to it, so that squared distances of up to 4,096 components fit a long.
FAR = 1 << 24
#: Parts whose distances to all entries one step computes.
_STEP = 2048
#: Slack below which rounding might hide a tie; such parts are scanned.
_EPS = 1e-3


@dataclass
class Codes:
    """``rows``: (vec_id, label, code, error), code with two hex digits a part; ``books``: part x entry x component;
    ``scanned``: parts scanned exactly in each pass, of ``n`` in all."""

    rows: DataFrame
    books: np.ndarray
    scanned: list[int]
    n: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _whole(scale: int, values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(np.float64)), -FAR, FAR).astype(np.int64)


def _scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of one part position: the nearest entry, of equal ones the first, and the slack to the next nearest."""
    near, slack = np.zeros(len(x), np.uint8), np.full(len(x), np.inf)
    for lo in range(0, len(x), _STEP):
        d = ((x[lo : lo + _STEP, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        row, at = np.arange(len(d)), d.argmin(axis=1)
        near[lo : lo + _STEP] = at
        if len(book) > 1:
            best = np.sqrt(d[row, at])
            d[row, at] = np.iinfo(np.int64).max
            slack[lo : lo + _STEP] = np.sqrt(d.min(axis=1)) - best
    return near, slack


class _Block:
    """Some vectors' scaled parts, the entries that hold them, and the heaps: the parts of an entry in ascending order of ``key``."""

    def __init__(self, x: np.ndarray, held: np.ndarray, member: np.ndarray, key: np.ndarray):
        self.x, self.held, self.member, self.key = x, held, member, key

    def turn(self, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, int]:
        """Pop, scan and push what ``drift`` has passed: the change of each entry's sums and counts, and the number popped."""
        parts, entries, width = books.shape
        heap = self.member % parts * entries + self.held.reshape(-1)[self.member]
        begin = np.searchsorted(heap, np.arange(parts * entries + 1))
        popped = []
        for h in range(parts * entries):
            a, b = begin[h], begin[h + 1]
            popped.append(np.arange(a, a + np.searchsorted(self.key[a:b], drift.reshape(-1)[h] + _EPS, "right")))
        out = np.concatenate(popped)
        member, flat = self.member[out], self.held.reshape(-1)
        now, key = np.zeros(len(out), np.uint8), np.zeros(len(out))
        for p in range(parts):
            mine = np.flatnonzero(member % parts == p)
            now[mine], slack = _scan(self.x[member[mine] // parts, p], books[p])
            key[mine] = slack + drift[p][now[mine]]
        change = np.zeros((parts * entries, width + 1), np.int64)
        moved = flat[member] != now
        for held, sign in ((flat[member[moved]], -1), (now[moved], 1)):
            to = member[moved] % parts * entries + held
            add = np.concatenate((self.x[member[moved] // parts, member[moved] % parts], np.ones((len(to), 1), np.int64)), axis=1)
            np.add.at(change, to, sign * add)
        flat[member] = now
        stay = np.ones(len(self.member), bool)
        stay[out] = False
        self._push(np.concatenate((self.member[stay], member)), np.concatenate((self.key[stay], key)), parts, entries)
        return change, len(out)

    def _push(self, member: np.ndarray, key: np.ndarray, parts: int, entries: int) -> None:
        order = np.lexsort((key, member % parts * entries + self.held.reshape(-1)[member]))
        self.member, self.key = member[order], key[order]


def _fresh(x: np.ndarray, books: np.ndarray) -> tuple[_Block, np.ndarray]:
    """A block with all parts scanned, and each entry's sums and counts."""
    n, parts, width = x.shape
    entries = books.shape[1]
    held, key = np.zeros((n, parts), np.uint8), np.zeros((n, parts))
    total = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        held[:, p], key[:, p] = _scan(x[:, p], books[p])
        np.add.at(total[p], held[:, p], np.concatenate((x[:, p], np.ones((n, 1), np.int64)), axis=1))
    block = _Block(x, held, np.zeros(0, np.int64), np.zeros(0))
    block._push(np.arange(n * parts), key.reshape(-1), parts, entries)
    return block, total


_STATE = "x binary, held binary, member binary, key binary, change binary, scanned long"


def _row(ids: pa.Array, labels: pa.Array, block: _Block, change: np.ndarray, scanned: int) -> pa.RecordBatch:
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    data = [block.x.astype(np.int32), block.held, block.member.astype(np.int32), block.key]
    return pa.RecordBatch.from_arrays(
        [one(ids), one(labels), *[pa.array([d.tobytes()], pa.binary()) for d in data], pa.array([treesum.packed(change)], pa.binary()), pa.array([scanned], pa.int64())],
        names=["ids", "labels", "x", "held", "member", "key", "change", "scanned"],
    )


def _first(books: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False)
                x = _whole(scale, flat).reshape(b.num_rows, books.shape[0], -1)
                block, total = _fresh(x, books)
                yield _row(b.column("vec_id"), b.column("label"), block, total, x.shape[0] * x.shape[1])

    return run


def _blocks(batch: pa.RecordBatch, shape: tuple[int, int, int]) -> Iterator[tuple[pa.Array, pa.Array, _Block]]:
    parts, _, width = shape
    for k in range(batch.num_rows):
        x, held, member, key = (np.frombuffer(batch.column(c)[k].as_py(), t).copy() for c, t in (("x", np.int32), ("held", np.uint8), ("member", np.int32), ("key", np.float64)))
        yield batch.column("ids")[k].values, batch.column("labels")[k].values, _Block(x.astype(np.int64).reshape(-1, parts, width), held.reshape(-1, parts), member.astype(np.int64), key)


def _next(books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, block in _blocks(batch, books.shape):
                change, scanned = block.turn(books, drift)
                yield _row(ids, labels, block, change, scanned)

    return run


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(books.shape[0])
        for batch in batches:
            for ids, labels, block in _blocks(batch, books.shape):
                error = ((block.x - books[part[None, :], block.held]) ** 2).sum(axis=(1, 2))
                code = [row.tobytes().hex() for row in block.held]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([task] * b.num_rows, pa.int32()), pa.array([0] * b.num_rows, pa.int32()), b.column("change")], names=["task", "slot", "data"])


def _kept(parts: int) -> Column:
    """Whole finite vectors whose length ``parts`` divides."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & good


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codes | None:
    """Train codebooks over ``vectors`` (vec_id, embedding, label) and code every row; None where no row is kept.

    A component x counts as floor(scale * x).  Rows are dropped if the vector is null, holds null or non-finite
    components, or has not the length of the vector of the smallest kept id (a multiple of ``parts``).  A codebook
    starts as its part of the ``entries`` (256 at most) smallest kept vec_ids, null ids last, of equal ids by vector;
    with fewer rows it has fewer entries.  Each round assigns parts to their nearest entries, ties to the lower index,
    and replaces entries by floor(sum / count); unused ones stay.  Then parts are assigned once more.  Rows that
    repeat a vec_id are coded each; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "codebooks")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].cast("array<double>").alias("embedding")).where(_kept(parts))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    head = rows.orderBy(*by_id).limit(1).collect()
    if not head:
        return None
    dim = len(head[0]["embedding"])
    rows = rows.where(F.size("embedding") == dim)
    start = np.array([r["embedding"] for r in rows.orderBy(*by_id).limit(entries).collect()])
    books = np.ascontiguousarray(_whole(scale, start).reshape(len(start), parts, dim // parts).transpose(1, 0, 2))

    schema = f"ids array<bigint>, labels array<{rows.schema['label'].dataType.simpleString()}>, {_STATE}"
    size = books.shape[0] * books.shape[1] * (books.shape[2] + 1)
    drift, total, scanned = np.zeros(books.shape[:2]), np.zeros(size, np.int64), []
    state = scratch.keep(rows.mapInArrow(tidy(_first(books, scale)), schema), "pass-0")
    for k in range(1, rounds + 1):
        change = treesum.tree_sum(state.select("change").mapInArrow(tidy(_changes), treesum.SCHEMA), state.rdd.getNumPartitions(), size)
        total = total + change[0]
        sums = total.reshape(*books.shape[:2], -1)
        count = sums[:, :, -1:]
        new = np.where(count > 0, np.floor_divide(sums[:, :, :-1], np.maximum(count, 1)), books)
        move = np.sqrt(((new - books) ** 2).sum(axis=2))
        other = np.where(np.eye(books.shape[1], dtype=bool)[None], 0, move[:, None, :]).max(axis=2)
        drift, books = drift + move + other, new
        state = scratch.keep(state.mapInArrow(tidy(_next(books, drift)), schema), f"pass-{k}")
        if k > 1:
            scratch.drop(f"pass-{k - 2}")
    for k in range(max(0, rounds - 1), rounds + 1):
        scanned.append(spark.read.parquet(scratch.path(f"pass-{k}")).agg(F.sum("scanned")).first()[0])
    out = scratch.keep(state.select("ids", "labels", "x", "held", "member", "key").mapInArrow(tidy(_coded(books)), f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"), "codes")
    return Codes(out, books, scanned, out.count() * parts)


def vector_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row (see :func:`compress`); an empty table has no rows.

    ``error``: squared distances to the final entries, summed over parts; ``label_error``: its sum over the
    rows of an equal label, nulls together.
    """
    got = compress(vectors)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    scratch = Scratch(vectors.sparkSession, "codebooks")
    each = scratch.keep(got.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    out = got.rows.join(each, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(got.digest()).alias("codebooks_sha256"))
