"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, tidy

_EDGE = "a long, b long"
#: Edges that one task contracts whole; more take distributed rounds.
SMALL = 16_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (member, smallest member) with the components of these edges."""
    ids, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    n, up = len(a), np.arange(len(ids))
    left, right = where[:n], where[n:]
    while True:
        x, y = up[left], up[right]
        if (x == y).all():
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
    keep = up != np.arange(len(ids))
    return ids[keep], ids[up[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as a star forest: at most one edge for each vertex seen."""
    for x in batches:
        a, b = forest(x.column("a").to_numpy(), x.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task as one star forest."""
    got = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if got:
        a, b = forest(*(np.concatenate(c) for c in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 200, contracted: bool = False) -> DataFrame:
    """``(id, component)`` for every vertex that is not the smallest of its component.

    Alternates large-star and small-star steps, with one written table a round;
    edges that share a task are contracted first, unless a Python task gives them
    ``contracted`` and needs no second one beside it.  ``edges`` has long columns
    ``a`` and ``b`` without nulls; loops and repeats are allowed.  A hub is met
    only in aggregations and in joins whose other side is unique, which Spark
    splits when skewed.  Rounds grow with the logarithm of a component's size;
    ``most_rounds`` only ends a run that cannot settle.
    """
    e = edges.where("a <> b")
    e = scratch.keep(e if contracted else e.mapInArrow(tidy(_contract), _EDGE), f"{name}-0")
    seen = None
    if e.count() <= SMALL:
        e = scratch.keep(e.repartition(1).mapInArrow(tidy(_whole), _EDGE), f"{name}-all")
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for k in range(1, most_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = small.union(mins.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        e = scratch.keep(out.mapInArrow(tidy(_contract), _EDGE).distinct(), f"{name}-{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
