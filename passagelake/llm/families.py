"""All pairs within candidate families, decided in blocks: a family of any size needs bounded memory a task.

A family of more than ``FAMILY_BLOCK`` members is first held against ``PIVOTS`` of its own, a pass in
which each member travels once.  What the pivots connect needs no comparison among itself any more: only the
members outside the largest connected part are then compared, with each other and with that part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .scratch import Scratch, tidy_group

#: Members of a family that one task compares with as many others.
FAMILY_BLOCK = 1000
PIVOTS = 8
#: ``decide(data, left, right)``: for each entry the smallest one it is connected with by a left and a right one.
Decide = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
_EDGE = "a long, b long"


def _within(decide: Decide):
    def run(table: pa.Table) -> pa.Table:
        """Units (family, lo, hi) of a task, each by itself; a member that comes twice in one block counts once."""
        ids, fam, lo, hi, own = (table.column(c).to_numpy() for c in ("id", "family", "lo", "hi", "block"))
        data = table.column("data").to_pylist()
        order = np.lexsort((ids, own, hi, lo, fam))
        unit, same = np.ones(len(order), bool), np.ones(len(order), bool)
        unit[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (fam, lo, hi)])
        same[1:] = unit[1:] | (own[order][1:] != own[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        cut = np.append(np.flatnonzero(unit), len(order))
        a, b = [], []
        for p, q in zip(cut[:-1], cut[1:], strict=True):
            mine = order[p:q][same[p:q]]
            if len(mine) > 1:
                label = decide([data[k] for k in mine], np.flatnonzero(own[mine] == lo[mine]), np.flatnonzero(own[mine] == hi[mine]))
                moved = np.flatnonzero(label != np.arange(len(label)))
                a.append(ids[mine[moved]])
                b.append(ids[mine[label[moved]]])
        none = np.zeros(0, np.int64)
        return pa.table(dict(zip("ab", graph.forest(np.concatenate([none, *a]), np.concatenate([none, *b])), strict=True)))

    return run


def _block(of: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(of), F.col(blocks)).cast("int")


def linked_within(family: DataFrame, rows: DataFrame, decide: Decide, scratch: Scratch, name: str) -> DataFrame:
    """Edges ``a, b`` that connect what ``decide`` links within each family.

    ``family``: ``(id, component)`` of all but the smallest member, as ``graph.components`` returns; ``rows``: ``(id, data)``,
    in which a member may come more than once with the same data.
    """
    own = family.select(F.col("component").alias("family"), "id").union(family.select(F.col("component").alias("family"), F.col("component").alias("id")).distinct())
    members = scratch.keep(own, f"{name}-members")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    large = scratch.keep(sizes.where(F.col("size") > FAMILY_BLOCK).withColumn("blocks", F.ceil(F.col("size") / FAMILY_BLOCK).cast("int")), f"{name}-large")
    tasks = max(1, -(-members.count() // FAMILY_BLOCK))

    def decided(units: DataFrame, task) -> DataFrame:
        return units.join(rows, "id").withColumn("task", task).groupBy("task").applyInArrow(tidy_group(_within(decide)), _EDGE)

    units = members.join(large.select("family"), "family", "left_anti").select("family", "id", *[F.lit(0).alias(c) for c in ("lo", "hi", "block")])
    small = decided(units, F.pmod(F.xxhash64("family"), F.lit(tasks)))
    if large.isEmpty():
        return small
    each = F.xxhash64("family", "lo", "hi")
    many = members.join(large, "family").withColumn("block", _block("id", "blocks"))
    draws = many.groupBy("family", "blocks").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("draw"), "id")).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = draws.select("family", "blocks", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.id") for k in range(PIVOTS)]))).alias("id"))
    pivots = pivots.select("family", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("hi"))
    units = many.select("family", "id", F.lit(-1).alias("lo"), F.col("block").alias("hi"), "block").union(pivots.select("family", "id", F.lit(-1), "hi", F.lit(-1)))
    star = scratch.keep(decided(units, each), f"{name}-star")

    label = graph.components(star, scratch, f"{name}-pivots", contracted=True)
    state = scratch.keep(many.select("family", "id", "size").join(label, "id", "left").withColumn("part", F.coalesce("component", "id")), f"{name}-parts")
    parts = state.groupBy("family", "size", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("family", "size").agg(F.max(F.struct("n", "part")).alias("m")).where("m.n < size")
    blocks = [F.ceil(x / FAMILY_BLOCK).cast("int").alias(c) for c, x in (("rest", F.col("size") - F.col("m.n")), ("most", F.col("m.n")))]
    left = state.select("family", "id", "part").join(main.select("family", F.col("m.part").alias("main"), *blocks), "family")
    # Blocks 0..rest-1 hold the members outside the largest part, the others that part; two of the latter never meet.
    left = left.withColumn("block", F.when(F.col("part") == F.col("main"), F.col("rest") + _block("id", "most")).otherwise(_block("id", "rest")))
    last = F.when(F.col("block") < F.col("rest"), F.col("rest") + F.col("most")).otherwise(F.col("rest"))
    pair = F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
    units = left.select("family", "id", "block", F.explode(pair).alias("p")).select("family", "id", "p.lo", "p.hi", "block")
    return small.union(star).union(decided(units, each))
