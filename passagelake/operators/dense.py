"""Nearest vectors where queries and vectors are both many: neither passes through the driver, whole or in blocks.

``PIVOTS`` of the vectors stand for the corpus.  A unit is the vectors nearest to one pivot whose distance from it lies in one of
``BANDS`` ranges: a number of units that does not grow, each with the least and greatest distance it holds.  By
the triangle inequality a query's distance to a pivot bounds its cosine with every vector of a unit.  A query first meets the units of the
highest bounds that hold ``k`` vectors; the k-th best score found there is its threshold, and it meets only
those of the other units whose bound reaches it.  The pivots' units form ``SHARES``, and a query goes to a share once, whatever the
number of its units there.  Queries and vectors of a share meet in blocks: a task holds about ``VECTORS`` vectors and ``QUERIES``
queries, however large the share, multiplies them unit by unit, and passes on the best ``k`` of each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec

PIVOTS, BANDS, SHARES = 64, 16, 8
#: Vectors and queries that meet in one task.
VECTORS, QUERIES = 32768, 16384
#: Queries planned at once, scores multiplied at once, and found ones held before they are cut to ``k`` a query.
PLANNED, CELLS, HELD = 1024, 1 << 21, 1 << 16
DIGITS = 9
#: More than rounding can take from a bound.
_SLACK = 1e-7
Keep = Callable[[DataFrame, str], DataFrame]


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of each query's best ``k`` positive scores (row x query), and of all that tie with the last of them."""
    which, row = [], []
    for j in range(score.shape[1]):
        mine = np.flatnonzero(score[:, j] > 0)
        if len(mine) > k:
            mine = mine[score[mine, j] >= np.partition(score[mine, j], -k)[-k]]
        which.append(np.full(len(mine), j))
        row.append(mine)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *which]), np.concatenate([none, *row])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def _dealt(pivots: np.ndarray):
    """Each vector's unit and its distance from the unit's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = _distance(unit_rows(matrix(b.column("embedding"), pivots.shape[1])), pivots)
                near = far.argmin(axis=1)
                dist = far[np.arange(len(far)), near]
                unit = near * BANDS + np.minimum(BANDS - 1, (dist * (BANDS / 2)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("embedding"), pa.array(unit, pa.int32()), pa.array(dist)], names=["key", "embedding", "unit", "dist"])

    return run


def _planned(pivots: np.ndarray, heads: np.ndarray, k: int, later: bool):
    """The units that a query meets: first those of the highest bounds that hold ``k`` vectors; later all others whose bound reaches ``theta``.

    A query goes to a share once, with the list of its units there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, low, high, n = heads[:, 0].astype(np.int64), heads[:, 1], heads[:, 2], heads[:, 3]
        share = unit // BANDS % SHARES
        for whole in batches:
            for b in (whole.slice(at, PLANNED) for at in range(0, whole.num_rows, PLANNED)):
                far = _distance(unit_rows(matrix(b.column("query_vector"), pivots.shape[1])), pivots)[:, unit // BANDS]
                least = np.maximum(0, np.maximum(far - high, low - far) - _SLACK)
                bound = 1 - least**2 / 2
                theta = b.column("theta").to_numpy()
                if later:
                    meets = ~_first(bound, n, k) & (bound >= theta[:, None] - _SLACK)
                else:
                    meets = _first(bound, n, k)
                for s in range(SHARES):
                    mine = meets[:, share == s]
                    rows = np.flatnonzero(mine.any(axis=1))
                    ends = np.concatenate([[0], np.cumsum(mine[rows].sum(axis=1))]).astype(np.int32)
                    units = pa.ListArray.from_arrays(pa.array(ends), pa.array(unit[share == s][np.nonzero(mine[rows])[1]], pa.int32()))
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(take), b.column("query_vector").take(take), pa.array(theta[rows]), pa.array(np.full(len(rows), s), pa.int32()), units], names=["query_id", "query_vector", "theta", "share", "units"])

    return run


def _first(bound: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    order = np.argsort(-bound, axis=1, kind="stable")
    held = np.cumsum(n[order], axis=1)
    out = np.zeros(bound.shape, bool)
    np.put_along_axis(out, order, held - n[order] < k, axis=1)
    return out


def _met(dim: int, k: int):
    """The best ``k`` of each query among a block's vectors, unit by unit, in products of at most ``CELLS``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = {"query_id": left.column("query_id"), "key": right.column("key")}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: x.slice(0, 0) for c, x in kind.items()} | {"score": pa.array([], pa.float64())})
        right = right.sort_by("key")  # of equal scores the smallest keys come first
        q, v = unit_rows(matrix(left.column("query_vector"), dim)), unit_rows(matrix(right.column("embedding"), dim))
        theta, unit = left.column("theta").to_numpy(), right.column("unit").to_numpy()
        lists = left.column("units").combine_chunks()
        asks, asked = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
        held, most = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)], HELD
        for u in np.unique(unit):
            rows, who = np.flatnonzero(unit == u), asks[asked == u]
            few = max(1, CELLS // len(rows))
            for some in (who[at : at + few] for at in range(0, len(who), few)):
                score = np.round(v[rows] @ q[some].T, DIGITS)
                which, row = np.nonzero((score >= theta[some]).T & (score > 0).T) if theta[some].all() else best_rows(score, k)
                if len(which) > k * len(some):
                    which, row = best_rows(score, k)
                held.append(_cut(some[which], rows[row], score[row, which], k))
            if sum(len(x[0]) for x in held) > most:
                held = [_cut(*map(np.concatenate, zip(*held, strict=True)), k)]
                most = max(HELD, 2 * len(held[0][0]))
        which, row, _ = _cut(*map(np.concatenate, zip(*held, strict=True)), k)
        score = np.concatenate([np.zeros(0), *(np.round((v[row[at : at + HELD]] * q[which[at : at + HELD]]).sum(axis=1), DIGITS) for at in range(0, len(row), HELD))])
        return pa.table({"query_id": kind["query_id"].take(pa.array(which)), "key": right.column("key").take(pa.array(row)), "score": pa.array(score)})

    return run


def _cut(which: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` highest scores, of equal ones the first rows."""
    order = np.lexsort((row, -score, which))
    which, row, score = which[order], row[order], score[order]
    place = np.arange(len(which)) - np.searchsorted(which, which)
    return which[place < k], row[place < k], score[place < k]


def _scored(plan: DataFrame, held: DataFrame, sizes: dict[int, int], dim: int, k: int, keep: Keep, name: str) -> DataFrame:
    """Scores of the planned queries in their units, blocks of either side of a share against blocks of the other."""
    plan = keep(plan, f"{name}-plan")
    asking = dict(map(tuple, plan.groupBy("share").count().collect()))  # a row for each share
    holds = {s: sum(n for u, n in sizes.items() if u // BANDS % SHARES == s) for s in range(SHARES)}
    blocks = lambda of, each: F.lit([-(-of.get(s, 0) // each) or 1 for s in range(SHARES)])
    vs, qs = F.get(blocks(holds, VECTORS), F.col("share")), F.get(blocks(asking, QUERIES), F.col("share"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    left = plan.select("query_id", "query_vector", "theta", "units", "share", F.pmod(F.xxhash64("query_id"), qs).alias("q"), every(vs).alias("v"))
    shared = held.withColumn("share", F.floor(F.col("unit") / BANDS).cast("int") % SHARES).where(F.col("share").isin(sorted(asking)))
    right = shared.select("key", "embedding", "unit", "share", every(qs).alias("q"), F.pmod(F.xxhash64("key"), vs).alias("v"))
    by = ["share", "q", "v"]
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query_id", plan), ("key", held))]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_met(dim, k), ", ".join([*kinds, "score double"]))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("key"))
    return keep(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n"), name)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, keep: Keep) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` vectors (key, embedding) of the highest positive cosine with each query (query_id,
    query_vector), of equal ones the smallest keys.

    Vectors with values that are no finite numbers, or of another length than the query, are never found.  ``keep(table, name)``
    writes a table and reads it back.
    """
    good = lambda df, c: df.where(vec.finite(F.col(c)) & (F.size(c) > 0))
    asked = keep(good(queries, "query_vector").select("query_id", "query_vector"), "asked")
    vectors_of = asked.schema["query_vector"].dataType.simpleString()
    ident, key = asked.schema["query_id"].dataType.simpleString(), vectors.schema["key"].dataType.simpleString()
    out = vectors.sparkSession.createDataFrame([], f"query_id {ident}, key {key}, score double")
    for dim in sorted(r[0] for r in asked.select(F.size("query_vector")).distinct().collect()):  # lengths, not vectors
        some = good(vectors, "embedding").where(F.size("embedding") == dim).select("key", "embedding")
        pivots = np.array([r[0] for r in some.orderBy(F.xxhash64("key")).limit(PIVOTS).select("embedding").collect()], np.float64)
        if not len(pivots):
            continue
        pivots = unit_rows(pivots)
        held = keep(some.mapInArrow(_dealt(pivots), f"key {key}, embedding {vectors.schema['embedding'].dataType.simpleString()}, unit int, dist double"), f"{dim}-held")
        heads = np.array(held.groupBy("unit").agg(F.min("dist"), F.max("dist"), F.count("*")).collect(), np.float64)
        sizes = {int(u): int(n) for u, _, _, n in heads}
        mine, schema = asked.where(F.size("query_vector") == dim), f"query_id {ident}, query_vector {vectors_of}, theta double, share int, units array<int>"
        first = _scored(mine.withColumn("theta", F.lit(0.0)).mapInArrow(_planned(pivots, heads, k, False), schema), held, sizes, dim, k, keep, f"{dim}-first")
        last = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("key"))
        theta = first.withColumn("n", F.row_number().over(last)).where(F.col("n") == k).select("query_id", F.col("score").alias("theta"))
        # A query that has met fewer than k so far takes whatever is positive.
        again = mine.join(theta, "query_id", "left").fillna(0.0, ["theta"])
        rest = _scored(again.mapInArrow(_planned(pivots, heads, k, True), schema), held, sizes, dim, k, keep, f"{dim}-rest")
        out = out.unionAll(first.unionAll(rest))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("key"))
    return out.where("score > 0").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
