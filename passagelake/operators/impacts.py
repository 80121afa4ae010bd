"""Lexical top-k that reads only what can enter it: postings by impact, and a bound for what stays unread.

A posting's impact is what its term adds to a document's score; but for the term's weight it hangs on count and length alone.  Impacts
fall into ``CLASSES`` equal ranges below the highest possible one, and a term's classes into tiers: the first ``HEAD`` postings or so make
tier 0, each further tier holds twice as many.  Tiers and term buckets are folders, so what a query batch does not need is not opened.
Postings are laid out run by run where their documents lie, each run with its share of ``HEAD``, so none is shuffled; the classes of a
run's terms, with their highest impacts, are columns of their own.

The documents that look best in tier 0 are scored in full: the k-th best score is a threshold below which no result lies.  A document unseen so far gets at most the best unread
impacts of the terms, so only terms that lift such a sum to the threshold are read on, and only classes that can.  Documents whose
partial sum and unread impacts together reach the threshold are scored in full, from a second copy of the postings by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import freeing
from . import blocks as bl
from . import ranking

CLASSES, HEAD, BUCKETS = 64, 128, 8
#: Documents scored in full for a threshold, as a multiple of k.
TRIED = 4
#: Documents in a shelf, and the most that their number is divided into; which ones a batch needs comes to the driver as numbers.
SHELF, SHELVES = 4096, 10_000
#: Postings that a task lays out at once.
RUN = 1 << 21
#: More than rounding of scores can hide.
_SLACK = 1e-6
Keep = Callable[[DataFrame, str], DataFrame]


def _laid(k1: float, b: float, avgdl: float, head: int):
    """Rows of a folder for each run: its terms, of each term the number of its classes, of each class its number, highest impact and
    number of postings, and of each posting its document, count and length."""
    classes, buckets, most = CLASSES, BUCKETS, RUN

    def laid(held: list[dict]) -> Iterator[pa.RecordBatch]:
        starts = lambda what: np.cumsum([0, *(len(h[what]) for h in held)])
        terms = pa.concat_arrays([h["words"] for h in held]).dictionary_encode()
        names, number = terms.dictionary, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.concatenate([number[h["word"] + at] for h, at in zip(held, starts("words"), strict=False)])
        doc = np.concatenate([h["doc"] + at for h, at in zip(held, starts("keys"), strict=False)])
        keys, tf = pa.concat_arrays([h["keys"] for h in held]), np.concatenate([h["tf"] for h in held])
        dl = np.concatenate([h["lengths"] for h in held])[doc]
        if not len(word):
            return
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * (dl / avgdl)))
        cls = np.clip(np.floor(classes * (1 - impact / (k1 + 1))), 0, classes - 1).astype(np.int64)
        order = np.argsort(word * classes + cls, kind="stable")
        group, first, n = np.unique((word * classes + cls)[order], return_index=True, return_counts=True)
        high = np.maximum.reduceat(impact[order], first)
        top = high.astype(np.float32)
        top = np.where(top < high, np.nextafter(top, np.float32(np.inf)), top)
        of, cls = np.divmod(group, classes)
        before = first - first[np.searchsorted(of, of)]
        tier = np.where(before < head, 0, np.floor(np.log2(np.maximum(before, 1) / head)) + 1).astype(np.int64)
        bucket = np.array([zlib.crc32(t.encode()) % buckets for t in names.to_pylist()], np.int64)[of]
        by = np.lexsort((group, bucket, tier))
        ends = np.flatnonzero(np.diff(tier[by] * buckets + bucket[by], append=-1)) + 1
        for some in np.split(by, ends[:-1]):
            each = n[some]
            rows = order[np.repeat(first[some] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            own, sizes = np.unique(of[some], return_counts=True)
            row = [pa.array([int(x[some[0]])], pa.int32()) for x in (tier, bucket)]
            row += [pc.binary_join(bl.listed(names.take(pa.array(own))), "\n"), *map(bl.packed, (sizes, cls[some], each)), pa.array([top[some].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*row, bl.listed(keys.take(pa.array(doc[rows]))), bl.packed(tf[rows]), bl.packed(dl[rows])], names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in bl.read(batches):
            held.append(block)
            size += len(block["word"])
            if size >= most:
                yield from laid(held)
                held, size = [], 0
        if held:
            yield from laid(held)

    return run


_COLUMNS = ["tier", "bucket", "words", "own", "cls", "n", "top", "keys", "tf", "dl"]


def _layout(key: T.DataType) -> T.StructType:
    kinds = {"tier": T.IntegerType(), "bucket": T.IntegerType(), "words": T.StringType(), "keys": T.ArrayType(key)}
    return T.StructType([T.StructField(c, kinds.get(c, T.BinaryType())) for c in _COLUMNS])


def _met(terms: list[str] | None, whole: bool):
    """Rows of the classes of these terms (of all without them), or, ``whole``, of their postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if terms is None else pa.array(terms, pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                words = bl.words_of(batch.column("words"), k)
                own = bl.unpacked(batch.column("own"), k, len(words))
                cls, n = (bl.unpacked(batch.column(c), k, int(own.sum())) for c in ("cls", "n"))
                hit = np.ones(len(words), bool) if asked is None else pc.is_in(words, value_set=asked).to_numpy(zero_copy_only=False).astype(bool)
                at = np.flatnonzero(np.repeat(hit, own))
                term = np.repeat(np.arange(len(words)), own)[at]
                tier, bucket = (batch.column(c)[k].as_py() for c in ("tier", "bucket"))
                if whole:
                    each, since = n[at], (np.cumsum(n) - n)[at]
                    row = np.repeat(since - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    tf, dl = (bl.unpacked(batch.column(c), k, int(n.sum())) for c in ("tf", "dl"))
                    term, cls = np.repeat(term, each), np.repeat(cls[at], each)
                    rest = {"key": batch.column("keys")[k].values.take(pa.array(row)), "tf": pa.array(tf[row]), "dl": pa.array(dl[row], pa.int32())}
                else:
                    top = np.frombuffer(batch.column("top")[k].as_buffer(), np.float32).astype(np.float64)
                    cls, rest = cls[at], {"bucket": pa.array(np.full(len(at), bucket), pa.int32()), "top": pa.array(top[at])}
                columns = {"term": words.take(pa.array(term)), "cls": pa.array(cls, pa.int32()), "tier": pa.array(np.full(len(cls), tier), pa.int32()), **rest}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _written(df: DataFrame, path: str, kind: T.StructType, *folders: str) -> DataFrame:
    with freeing(df.sparkSession):
        out = df.write.option("compression", "zstd").option("parquet.block.size", bl.GROUP).option("parquet.page.size.row.check.min", 10)
        out.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(kind).parquet(path)


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


@dataclass(frozen=True)
class ImpactIndex:
    """``blocks``: a run's postings of a folder of tier and bucket, with the classes of their terms; ``forward``: blocks of whole documents in
    folders of shelves; ``idf`` and ``lengths`` of the index they come from, and the parameters that the classes were made with."""

    blocks: DataFrame
    forward: DataFrame
    idf: DataFrame
    lengths: DataFrame
    k1: float
    b: float

    @staticmethod
    def build(index: ranking.LexicalIndex, root: str, k1: float = ranking.K1, b: float = ranking.B) -> ImpactIndex:
        """Write both tables of an index below ``root``; ``k1`` and ``b`` are fixed with them."""
        spark, source = index.postings.sparkSession, index.blocks if index.blocks is not None else bl.gathered(index.postings)
        bl.bounded(spark)
        key = source.schema["keys"].dataType.elementType
        n, avgdl = index.lengths.select("n", "avgdl").first() or (0, None)
        shelf = T.StructType([*bl.schema(key).fields, T.StructField("shelf", T.LongType())])

        # A shelf is a few neighbouring blocks of one task.
        few = max(1, max(SHELF, -(-n // SHELVES)) * source.count() // max(n, 1))
        at, task = F.monotonically_increasing_id(), F.spark_partition_id().cast("long")
        place = task * (1 << 33) + F.floor(at.bitwiseAND((1 << 33) - 1) / few)
        forward = _written(source.select(*bl.schema(key).names).withColumn("shelf", place.cast("long")), f"{root}/forward", shelf, "shelf")
        # Each run brings a share of the first tier.
        runs = -(-int(n * (avgdl or 0)) // RUN)
        laid = forward.drop("shelf", "length", "found").mapInArrow(_laid(k1, b, avgdl or 1.0, max(1, HEAD // max(runs, 1))), _layout(key))
        return ImpactIndex(_written(laid, f"{root}/blocks", _layout(key), "tier", "bucket"), forward, index.idf, index.lengths, k1, b)

    def _opened(self, parts: list[tuple[int, int]]) -> DataFrame:
        """The blocks of these folders (tier, bucket); as many as the layout has, at most."""
        tiers: dict[int, list[int]] = {}
        for t, u in parts:
            tiers.setdefault(t, []).append(u)
        want = F.lit(False)
        for t, us in sorted(tiers.items()):
            want = want | ((F.col("tier") == t) & F.col("bucket").isin(sorted(us)))
        return self.blocks.where(want)

    def topk(self, wanted: DataFrame, k: int, keep: Keep) -> DataFrame:
        """``query_id, key, score, rank`` of the ``k`` best documents for each query (query_id, term), as the full scan finds them.

        ``keep(table, name)`` writes a table and reads it back: a round starts from what the last one found.
        """
        weighed = wanted.join(self.idf.select("term", "idf"), "term").crossJoin(self.lengths.select("avgdl"))  # one row
        weighed = keep(weighed.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int")), "weighed")
        names = [r[0] for r in weighed.select("term").distinct().limit(ranking.ASKED + 1).collect()]
        names = names if len(names) <= ranking.ASKED else None  # more meet the postings in the joins alone
        buckets = [r[0] for r in weighed.select("bucket").distinct().collect()]
        heads = self.blocks.where(F.col("bucket").isin(buckets)).select("tier", "bucket", "words", "own", "cls", "n", "top")
        heads = heads.mapInArrow(_met(names, False), "term string, cls int, tier int, bucket int, top double").drop("bucket").join(weighed, "term")
        heads = heads.groupBy("query_id", "term", "cls", "tier", "bucket").agg(F.max(F.col("idf") * F.col("top")).alias("top"))  # of all runs
        heads = keep(heads, "heads")
        rest = heads.groupBy("query_id", "term").agg(F.coalesce(F.max(F.when(F.col("tier") > 0, F.col("top"))), F.lit(0.0)).alias("rest"))
        asked = keep(weighed.join(rest, ["query_id", "term"]), "asked")
        part = ranking.part(self.k1, self.b).alias("part")
        first = self._postings(self._opened([(0, u) for u in buckets]), names)
        seen = keep(first.join(asked, "term").select("query_id", "key", "term", part, "rest"), "seen-0")

        asked = asked.drop("bucket")
        low = seen.groupBy("query_id", "key").agg(F.sum("part").alias("low"))
        best = low.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc(), "key")))
        tried = self._whole(keep(best.where(F.col("n") <= TRIED * k).select("query_id", "key"), "tried"), asked)
        theta = keep(ranking.topk(tried, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("theta")), "theta")
        ascending = Window.partitionBy("query_id").orderBy("rest", "term")
        terms = asked.join(theta, "query_id", "left").fillna(0.0, ["theta"])
        terms = terms.withColumn("upto", F.sum("rest").over(ascending)).withColumn("all", F.sum("rest").over(Window.partitionBy("query_id")))
        essential = terms.where((F.col("rest") > 0) & (F.col("upto") >= F.col("theta") - _SLACK)).select("query_id", "term", "rest", "all", "theta")
        more = heads.where("tier > 0").join(essential, ["query_id", "term"]).where(F.col("top") + F.col("all") - F.col("rest") >= F.col("theta") - _SLACK)
        more = keep(more.select("query_id", "term", "cls", "tier", "bucket", "rest"), "more")
        opened = self._opened([tuple(r) for r in more.select("tier", "bucket").distinct().collect()])
        further = self._postings(opened, names).join(more.drop("bucket", "rest"), ["term", "cls", "tier"]).join(asked, ["query_id", "term"])
        further = further.select("query_id", "key", "term", part, "rest")
        seen = keep(seen.unionByName(further), "seen-1")

        sums = terms.groupBy("query_id").agg(F.max("all").alias("all"), F.max("theta").alias("theta"))
        found = seen.groupBy("query_id", "key").agg(F.sum("part").alias("low"), F.sum("rest").alias("met"))
        able = found.join(sums, "query_id").where(F.col("low") + F.col("all") - F.col("met") >= F.col("theta") - _SLACK)
        return ranking.topk(self._whole(keep(able.select("query_id", "key"), "able"), asked), k)

    def _postings(self, opened: DataFrame, terms: list[str] | None) -> DataFrame:
        """``term, cls, tier, key, tf, dl`` of these terms."""
        fields = [("term", T.StringType()), ("cls", T.IntegerType()), ("tier", T.IntegerType()), ("key", self.blocks.schema["keys"].dataType.elementType), ("tf", T.LongType()), ("dl", T.IntegerType())]
        return opened.drop("top").mapInArrow(_met(terms, True), T.StructType([T.StructField(*f) for f in fields]))

    def _whole(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """``query_id, key, score`` in full, from the shelves that hold these documents."""
        held = self.forward.select("shelf", F.explode("keys").alias("held"))
        keys = pairs.select("key").distinct()
        shelves = [r[0] for r in held.join(keys, _same("held", "key"), "left_semi").select("shelf").distinct().collect()]
        rows = self.forward.where(F.col("shelf").isin(shelves) if shelves else F.lit(False)).drop("shelf")
        pairs = pairs.select(F.col("query_id").alias("for"), F.col("key").alias("of"))
        return ranking.summed(bl.postings(rows), rows, asked, self.k1, self.b).join(pairs, _same("query_id", "for") & _same("key", "of"), "left_semi")
