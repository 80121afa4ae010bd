"""The difference of two snapshots of keyed rows, in which rows whose key changed are found again by their content.

Rows with equal keys are a pair.  What stays unpaired is matched by content: of equal contents the i-th
earlier key with the i-th later key.  The rank of a key comes from a counted order-statistic tree for each
content and side: leaves are ranges of ``2**LEAF_BITS`` key values, a node covers ``2**FAN_BITS`` ranges below it,
and each carries the number of its rows.  A leaf's first rank is the sum of what stands before it on the way down, so
selecting the i-th key on either side is a join on ``(content, i)``, and no task holds more than a leaf or the
children of one node, however many copies a content has.  A content of at most ``LEAF`` rows is one leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import NULL_ID, Scratch

#: Rows of a content and side up to which its tree is a single leaf.
LEAF = 128
#: Key values in a leaf, and children of a node, as powers of two.
LEAF_BITS, FAN_BITS = 7, 10


def _before(group: list[str], order: str) -> Column:
    """Rows of the group's nodes that stand before this one."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _leaf_starts(rows: DataFrame, group: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``(*group, node, start)``: the rank of each leaf's first row, summed down the tree."""
    level = rows.groupBy(*group, F.shiftright("at", LEAF_BITS).alias("node")).agg(F.count("*").alias("n"))
    levels = [scratch.keep(level, f"{name}-tree-0")]
    lo, hi = levels[0].agg(F.min("node"), F.max("node")).first()
    while hi - lo >= 1 << FAN_BITS:
        lo, hi = lo >> FAN_BITS, hi >> FAN_BITS
        level = levels[-1].groupBy(*group, F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"))
        levels.append(scratch.keep(level, f"{name}-tree-{len(levels)}"))
    start = levels[-1].select(*group, "node", _before(group, "node").alias("start"))
    for level in reversed(levels[:-1]):
        own = level.withColumn("parent", F.shiftright("node", FAN_BITS)).withColumn("own", _before([*group, "parent"], "node"))
        above = start.withColumnRenamed("node", "parent")
        start = own.join(above, [*group, "parent"]).select(*group, "node", (F.col("start") + F.col("own")).alias("start"))
    return start


def ranked(rows: DataFrame, group: list[str], ties: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` and ``i``, the rank from 0 of the long ``at`` in its group; rows that share ``at`` are ordered by ``ties``.

    ``group`` holds no nulls.  Rows of one group with equal ``at`` stand in one leaf.
    """
    large = rows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > LEAF).select(*group)
    large = scratch.keep(large, f"{name}-large")
    here = F.row_number().over(Window.partitionBy(*group).orderBy("at", *ties)) - 1
    small = rows.join(large, group, "left_anti").withColumn("i", here.cast("long"))
    if large.isEmpty():
        return small
    many = scratch.keep(rows.join(large, group, "left_semi"), f"{name}-many")
    starts = _leaf_starts(many, group, scratch, name)
    here = F.row_number().over(Window.partitionBy(*group, "node").orderBy("at", *ties)) - 1
    many = many.withColumn("node", F.shiftright("at", LEAF_BITS)).withColumn("i", here).join(starts, [*group, "node"])
    return small.unionByName(many.withColumn("i", F.col("start") + F.col("i")).drop("node", "start"))


def _rows(df: DataFrame, key: str, columns: list[str], by: str) -> DataFrame:
    """Key, digest of the content, the other columns and the row's digest: no content travels any further."""
    text = {c: df[f"`{c}`"].cast("string") for c in columns}
    line = reduce(lambda a, c: F.concat(a, F.lit("\n"), F.coalesce(text[c], F.lit("~"))), columns[1:], F.coalesce(text[columns[0]], F.lit("~")))
    kept = [text[c].alias(f"c{n}") for n, c in enumerate(columns) if c != by]
    return df.select(df[f"`{key}`"].cast("long").alias("k"), F.coalesce(F.unhex(F.sha2(text[by], 256)), F.lit(b"")).alias("content"), *kept, F.sha2(line, 256).alias("sha"))


def _numbered(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` and ``nth``, which tells rows that repeat a key apart: their order by digest, of equal rows any."""
    rows = scratch.keep(rows, name)
    again = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.coalesce("k", F.lit(NULL_ID)).alias("id"), F.col("k").isNull().alias("none"))
    again = scratch.keep(again, f"{name}-again")
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    # 40 bits of the row's digest in front, then bits of the row's place: equal rows fill many leaves.
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 40)
    at = F.shiftleft(F.shiftright(F.xxhash64("sha"), 24), 24).bitwiseOR(place)
    of = rows.withColumn("id", F.coalesce("k", F.lit(NULL_ID))).withColumn("none", F.col("k").isNull()).withColumn("at", at)
    once = of.join(again, ["id", "none"], "left_anti").withColumn("i", F.lit(0).cast("long"))
    many = ranked(of.join(again, ["id", "none"], "left_semi"), ["id", "none"], ["sha"], scratch, f"{name}-nth")
    return once.unionByName(many).drop("id", "none", "at").withColumnRenamed("i", "nth")


def snapshot_difference(earlier: DataFrame, later: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("text", "lang", "source"), by: str = "text", descending: bool = False) -> DataFrame:
    """One row per pair or unpaired row: ``key, old_key, op, changed, row_sha256``.

    Rows with equal keys pair (``same``, or ``update`` if one of ``columns`` differs); of the others with equal ``by``,
    the i-th smallest earlier key pairs with the i-th smallest later key, or with the i-th largest where
    ``descending`` (``rekey``); the rest are ``insert`` and ``delete``.  ``key`` is the later one, else the earlier;
    ``old_key`` the earlier one; ``changed`` names a pair's differing columns; ``row_sha256`` digests the later row's
    columns, joined by line feeds, null as ``~``.

    Nulls equal only nulls, as keys and in every column; a null key is the smallest.  Rows that repeat a key within a
    snapshot are numbered in the order of their digests, and the n-th pairs with the n-th; equal ones are
    interchangeable.  Empty texts are contents like others.  Further columns are ignored, whatever their
    names; two empty snapshots have no difference.
    """
    scratch = Scratch(earlier.sparkSession, "snapshots")
    names = list(columns)
    others = [f"c{n}" for n, c in enumerate(names) if c != by]
    side = [_numbered(_rows(df, key, names, by), scratch, name) for df, name in ((earlier, "earlier"), (later, "later"))]
    e, l = (df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns], F.lit(True).alias(f"in_{x}")) for df, x in zip(side, "el", strict=True))
    met = scratch.keep(e.join(l, F.col("k_e").eqNullSafe(F.col("k_l")) & (F.col("nth_e") == F.col("nth_l")), "full"), "met")
    differs = [~F.col(f"c{n}_e").eqNullSafe(F.col(f"c{n}_l")) if c != by else F.col("content_e") != F.col("content_l") for n, c in enumerate(names)]
    changed = F.concat_ws(",", *[F.when(d, F.lit(c)) for d, c in zip(differs, names, strict=True)])
    pairs = met.where("in_e and in_l").select(F.col("k_l").alias("key"), F.col("k_e").alias("old_key"), F.when(changed == "", "same").otherwise("update").alias("op"), changed.alias("changed"), F.col("sha_l").alias("row_sha256"))

    alone = [met.where(where).select(F.lit(x).alias("side"), *[F.col(f"{c}_{x}").alias(c) for c in ("content", "k", "nth", "sha", *others)]) for x, where in (("e", "in_l is null"), ("l", "in_e is null"))]
    at = F.coalesce("k", F.lit(NULL_ID))
    rows = ranked(alone[0].union(alone[1]).withColumn("at", F.when(F.col("side") == "l", F.bitwise_not(at)).otherwise(at) if descending else at), ["content", "side"], ["k", "nth"], scratch, "alone")
    rows = scratch.keep(rows.drop("at", "nth"), "ranked")
    e, l = (rows.where(F.col("side") == x).select("content", "i", *[F.col(c).alias(f"{c}_{x}") for c in ("k", "sha", *others)], F.lit(True).alias(f"in_{x}")) for x in "el")
    found = e.join(l, ["content", "i"], "full").withColumns({"content_e": F.col("content"), "content_l": F.col("content")})
    op = F.when(F.col("in_e").isNull(), "insert").when(F.col("in_l").isNull(), "delete").otherwise("rekey")
    return pairs.union(
        found.select(
            F.when(F.col("in_l").isNull(), F.col("k_e")).otherwise(F.col("k_l")), F.col("k_e"), op, F.when(op == "rekey", changed).otherwise(""), F.col("sha_l")
        )
    )


def changed_snapshot(docs: DataFrame) -> DataFrame:
    """A later snapshot of ``(doc_id, text, lang, source)``, made by crc32 of the decimal ``doc_id`` modulo 16: 0 drops the
    row, 1 appends ``+`` to the text, 2 swaps lang and source, 3 turns the key into -1 - key, 4 does so and sets source null, 5 adds a copy
    under that key.  Rows without a ``doc_id`` stay as they are."""
    of = docs.select(F.col("doc_id").cast("long").alias("id"), *[docs[c].cast("string").alias(c) for c in ("text", "lang", "source")])
    of = of.withColumn("way", F.coalesce(F.crc32(F.col("id").cast("string")) % 16, F.lit(-1))).where("way <> 0")
    turned, way = -1 - F.col("id"), F.col("way")
    keys = F.when(way.isin(3, 4), F.array(turned)).when(way == 5, F.array(F.col("id"), turned)).otherwise(F.array("id"))
    return of.select(
        F.explode(keys).alias("doc_id"), F.when(way == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(way == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"), F.when(way == 2, F.col("lang")).when(way != 4, F.col("source")).alias("source"),
    )
