"""Rows that share a table key, as a spanning forest instead of all pairs.

A task first joins its own rows that share a key to one leader among them and
passes only that leader on, so a key held by a third of all rows reaches its
bucket as one entry for each task.  The bucket then joins the leaders.  Leaders
are drawn by a hash of key and row: each of many tables has another one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import tidy, tidy_group
from .textvec import U, mix

#: Entries that a task gathers before it sorts and deals them out.
GATHER = 1 << 21
_ROW = "bucket int, kind int, x binary, y binary"
KEYS, EDGES = 0, 1


def _star(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Leaders (key, row) and edges (row, leader) of entries with equal keys."""
    order = np.lexsort((mix(key ^ mix(row.astype(U))), key))
    key, row = key[order], row[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    leader = row[head][np.cumsum(head) - 1]
    edge = (row != leader) & ~head
    return key[head], row[head], row[edge], leader[edge]


def _dealt(kind: int, by: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> Iterator[tuple]:
    bucket = (mix(by) % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, x, y = bucket[order], x[order], y[order]
    cut = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            yield int(bucket[a]), kind, x[a:b].tobytes(), y[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    b, k, x, y = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["bucket", "kind", "x", "y"])


def _unique_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    keep = np.ones(len(lo), bool)
    keep[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[keep], hi[keep]


def colliding(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int) -> DataFrame:
    """Distinct edges ``a < b`` that span, for each key, the rows holding it.

    ``keys_of(batch)`` yields pairs of arrays (uint64 key, int64 row id).
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0

        def flush():
            key, row, a, b = _star(*(np.concatenate(z) for z in zip(*got, strict=True)))
            a, b = _unique_edges(a, b)
            yield _batch([*_dealt(KEYS, key, key, row, buckets), *_dealt(EDGES, a.astype(U), a, b, buckets)])

        for batch in batches:
            for key, row in keys_of(batch):
                got.append((key, row))
                size += len(key)
                if size >= GATHER:
                    yield from flush()
                    got, size = [], 0
        if got:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        xs, ys = table.column("x").to_pylist(), table.column("y").to_pylist()

        def joined(values: list[bytes], k: int, dtype) -> np.ndarray:
            return np.frombuffer(b"".join(v for v, w in zip(values, kind, strict=True) if w == k), dtype)

        _, _, a, b = _star(joined(xs, KEYS, U), joined(ys, KEYS, np.int64))
        a, b = _unique_edges(np.concatenate((a, joined(xs, EDGES, np.int64))), np.concatenate((b, joined(ys, EDGES, np.int64))))
        return pa.table({"a": a, "b": b})

    return rows.mapInArrow(tidy(deal), _ROW).groupBy("bucket").applyInArrow(tidy_group(meet), "a long, b long").distinct()
