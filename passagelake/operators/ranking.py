"""Lexical and dense ranking, fusion, re-ranking and their measures, for many queries at once.

Sides are never broadcast by hint: Spark broadcasts those it finds small enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import vectors as vec
from ..sources.shared import Folder
from . import blocks as bl
from . import dense

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 61
DIGITS = 9
#: Parts of a score are added as whole multiples of 1 / SCALE: equal parts give equal sums in whatever order they come.
SCALE = float(1 << 43)
#: Sums that differ by more than this differ in their rounded scores too.
SLACK = int(SCALE / 10**DIGITS) + 2
#: Terms of queries that go to all blocks.
ASKED = 1 << 16


def topk(df: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "key") -> DataFrame:
    """The ``k`` highest positive scores of each ``by``, ties by the smallest key, with a rank from 1."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(key))
    return df.where(F.col(score) > 0).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def document_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, terms`` of each document, in any script."""
    return docs.select(F.col(key).alias("key"), tx.any_words(F.col(text)).alias("terms"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term``: a query is the set of its terms."""
    return queries.select("query_id", F.explode(F.array_distinct(tx.any_words(F.col("query")))).alias("term"))


def inverse_frequencies(terms: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """``term, df, idf``: ln((N - df + .5) / (df + .5)); not above zero: epsilon times the vocabulary's mean, or epsilon."""
    # Each document also counts under the empty term, which no text holds: N comes from the same
    # aggregation, whose exchange all three uses share, so the texts are read once.
    marked = terms.select(F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("term")).where("term is not null")
    return _weighed(marked.groupBy("term").agg(F.count("*").alias("df")), epsilon)


def _raw() -> Column:
    return F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _floor(raw: Column, epsilon: float) -> Column:
    """Of whole multiples of 1 / SCALE, as :func:`total`: the same in whatever order the terms come."""
    return (F.lit(epsilon) * F.avg(F.rint(raw * SCALE).cast("long").cast("decimal(20,0)")).cast("double") / SCALE).alias("floor")


def _above(raw: Column, epsilon: float) -> Column:
    floor = F.when(F.col("floor") > 0, F.col("floor")).otherwise(F.lit(epsilon))
    return F.when(raw > 0, raw).otherwise(floor).alias("idf")


def _weighed(df: DataFrame, epsilon: float) -> DataFrame:
    """``term, df, idf`` from document counts, among which the empty term's is the number of documents."""
    n = df.agg(F.max(F.when(F.col("term") == "", F.col("df"))).alias("n"))
    raw = df.crossJoin(n).withColumn("raw", F.when(F.col("term") != "", _raw()))  # one row
    mean = raw.agg(_floor(F.col("raw"), epsilon))
    return raw.crossJoin(mean).where("raw is not null").select("term", "df", _above(F.col("raw"), epsilon))


#: Words that a task counts at once; a document of more is counted alone.
COUNTED = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each row (key, dl, terms): words by their numbers in the batch's dictionary, then pairs of row and number."""
    for batch in batches:
        upto = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)))).astype(np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + COUNTED, "right")) - 1)
            some, sizes = batch.slice(lo, hi - lo), np.diff(upto[lo : hi + 1])
            words = some.column("terms").flatten().dictionary_encode()
            pair = np.repeat(np.arange(hi - lo), sizes) * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False)
            pair, tf = np.unique(pair, return_counts=True)
            row, word = np.divmod(pair, max(len(words.dictionary), 1))
            columns = [words.dictionary.take(pa.array(word)), *(some.column(c).take(pa.array(row)) for c in ("key", "dl"))]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(tf.astype(np.int64)), columns[2]], names=["term", "key", "tf", "dl"])
            lo = hi


def postings_of(terms: DataFrame) -> DataFrame:
    """``term, key, tf, dl``: a row for each term of each document; one that has none is under the empty term.

    Words are counted before they are rows.  Rows of one key count as one document.
    """
    whole = terms.groupBy("key").agg(F.flatten(F.collect_list("terms")).alias("terms"), F.first(F.size("terms")).alias("dl"))
    each = whole.select("key", "dl", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.array(F.lit(""))).alias("terms"))
    key = T.StructField("key", terms.schema["key"].dataType)
    return each.mapInArrow(_counted, T.StructType([T.StructField("term", T.StringType()), key, T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())]))


def part(k1: float, b: float) -> Column:
    """What a posting adds to its document's score: from ``idf, tf, dl`` and the mean length ``avgdl``."""
    f, rel = F.col("tf"), F.col("dl") / F.col("avgdl")
    return F.col("idf") * f * (k1 + 1) / (f + k1 * (1 - b + b * rel))


def total(part: Column) -> Column:
    """A score from the parts of a group's rows, without a list of them."""
    return F.round(F.sum(F.rint(part * SCALE).cast("long")) / SCALE, DIGITS)


@dataclass(frozen=True)
class LexicalIndex:
    """Postings and what follows from them alone, so that no query reads a text: tables as written once for a corpus."""

    postings: DataFrame
    idf: DataFrame
    lengths: DataFrame
    blocks: DataFrame | None = None

    @staticmethod
    def of_texts(docs: DataFrame, epsilon: float = EPSILON, keep: Callable[..., DataFrame] = lambda df, *_: df) -> LexicalIndex:
        """An index of documents (doc_id, text) kept in blocks, whose postings are rows only where a query asks for rows."""
        b = keep(bl.of(docs, keep=keep), "blocks", bl.GROUP)
        per = b.agg(F.coalesce(F.sum(F.size("keys").cast("long")), F.lit(0)).alias("n"), F.sum("length").alias("length"))
        lengths = keep(per.select("n", F.when(F.col("n") > 0, F.col("length").cast("double") / F.col("n")).alias("avgdl")), "lengths")
        counts = keep(bl.frequencies(b), "counts").crossJoin(lengths.select("n"))  # one row
        floor = keep(counts.agg(_floor(_raw(), epsilon)), "floor")
        return LexicalIndex(bl.postings(b), counts.crossJoin(floor).select("term", "df", _above(_raw(), epsilon)), lengths, b)

    @staticmethod
    def of(postings: DataFrame, epsilon: float = EPSILON, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> LexicalIndex:
        """``keep(table, name)`` writes a table and reads it back; without it everything is counted anew for each query."""
        p = keep(postings, "postings")
        counts = p.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
        per = p.groupBy("key").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
        lengths = keep(per, "lengths")
        return LexicalIndex(p.where("term <> ''"), keep(_weighed(counts.union(lengths.select(F.lit(""), "n")), epsilon), "idf"), lengths)

    @staticmethod
    def merged(blocks: DataFrame, stats: DataFrame, epsilon: float = EPSILON, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> LexicalIndex:
        """An index of blocks whose weights and lengths are sums of statistics (term, df, length) of parts: negative ones take away, and the empty
        term has the number of documents and their length."""
        sums = stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
        whole = sums.where("term = ''").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"), F.max("length").alias("length"))
        lengths = keep(whole.select("n", F.when(F.col("n") > 0, F.col("length").cast("double") / F.col("n")).alias("avgdl")), "lengths")
        counts = sums.where("term <> '' and df > 0").select("term", "df")
        return LexicalIndex(bl.postings(blocks), keep(_weighed(counts.union(lengths.select(F.lit(""), "n")), epsilon), "idf"), lengths, blocks)

    def scores(self, wanted: DataFrame, k1: float = K1, b: float = B, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df, best: int | None = None) -> DataFrame:
        """``query_id, key, score`` of every document that holds one of a query's terms (query_id, term).

        With ``best`` rows that are not among the best so many of their query may be missing.  Up to ``ASKED`` terms go to all
        blocks, where a document's score is summed up in the task that holds it; more meet the postings in a join.
        With ``keep`` the weighed terms are written first: Spark knows how few they are and takes them to the postings, whose
        documents lie together, so that what is shuffled is one sum for each pair of a task.
        """
        weighed = keep(wanted.join(self.idf.select("term", "idf"), "term").crossJoin(self.lengths.select("avgdl")), "asked")  # one row
        return summed(self.postings, self.blocks, weighed, k1, b, best)


def summed(postings: DataFrame, blocks: DataFrame | None, weighed: DataFrame, k1: float, b: float, best: int | None = None) -> DataFrame:
    """``query_id, key, score`` of every document that holds a weighed term (query_id, term, idf, avgdl), from blocks where they are there."""
    few = weighed.select("query_id", "term", "idf", "avgdl").limit(ASKED + 1).collect() if blocks is not None else []
    if blocks is not None and len(few) <= ASKED:
        return bl.sums(blocks, few, weighed.schema["query_id"].dataType, few[0]["avgdl"] if few else 1.0, k1, b, SCALE, best, SLACK, DIGITS)
    return postings.join(weighed, "term").groupBy("query_id", "key").agg(total(part(k1, b)).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, key, score`` of every document that holds a term of the query, without a stored index."""
    return LexicalIndex.of(postings_of(document_terms(docs))).scores(query_terms(queries), k1, b)


#: Query vectors that one pass over the vectors answers; more meet the vectors in blocks of both (see ``dense``).
QUERY_BLOCK = 1024


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` nearest vectors (key, embedding) of each query (query_id, query_vector).

    At most ``QUERY_BLOCK`` queries go to all tasks; a task multiplies its batches of vectors with them and passes on the best ``k``
    of each query, so nothing but these is shuffled.  More queries stay distributed.  Vectors with values that
    are no finite numbers, or of another length than the query, are never found.
    """
    asked = queries.where(vec.finite(F.col("query_vector"))).select("query_id", "query_vector")
    block = asked.limit(QUERY_BLOCK + 1).collect()
    if len(block) > QUERY_BLOCK:
        return dense.nearest(vectors, asked, k, Folder(vectors.sparkSession, "nearest").keep)
    key = vectors.schema["key"].dataType.simpleString()
    ident = asked.schema["query_id"].dataType.simpleString()
    out = vectors.sparkSession.createDataFrame([], f"query_id {ident}, key {key}, score double")
    for dim in sorted({len(r[1]) for r in block}):
        some = [r for r in block if len(r[1]) == dim]
        best = _best_of_block(vectors, [r[0] for r in some], np.array([r[1] for r in some], np.float64), k, asked.schema["query_id"], vectors.schema["key"])
        out = out.unionAll(best)
    return topk(out, k)


def _best_of_block(vectors: DataFrame, ids: list, asked: np.ndarray, k: int, ident, key) -> DataFrame:
    dim = asked.shape[1]
    held = vectors.sparkSession.sparkContext.broadcast((ids, dense.unit_rows(asked)))  # at most QUERY_BLOCK vectors
    schema = T.StructType([T.StructField("query_id", ident.dataType), T.StructField("key", key.dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.round(dense.unit_rows(dense.matrix(batch.column("embedding"), dim)) @ q.T, DIGITS)
            which, row = dense.best_rows(score, k)
            yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in which]), batch.column("key").take(pa.array(row)), pa.array(score[row, which])], schema=pa.schema([("query_id", pa.array(ids).type), ("key", batch.column("key").type), ("score", pa.float64())]))

    some = vectors.where((F.size("embedding") == dim) & vec.finite(F.col("embedding"))).select("key", "embedding")
    found = some.mapInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("key"))
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def validated_weights(weights: dict[str, float] | None, names: Sequence[str]) -> dict[str, float]:
    """Weights of all lists ``names``, adding to 1: equal ones where none are given; negative or only zero ones are errors."""
    w = {n: 1.0 for n in names} if weights is None else {n: float(weights.get(n, 0.0)) for n in names}
    if any(x < 0 or x != x for x in w.values()):
        raise ValueError(f"weights must not be negative: {w}")
    total = sum(w.values())
    if not total > 0:
        raise ValueError("weights must not all be zero")
    return {n: x / total for n, x in w.items()}


def weights_present(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``ranked`` (query_id, list, key, rank, score) with each list's weight over those of the query's lists with hits."""
    w = F.coalesce(*[F.when(F.col("list") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    lists = ranked.select("query_id", "list").distinct().withColumn("w", w)
    lists = lists.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).drop("w")
    return ranked.join(lists, ["query_id", "list"])


def fused(ranked: DataFrame, weights: dict[str, float], how: str = "rrf", k: int = RRF_K) -> DataFrame:
    """``query_id, key, score`` and each list's contribution, of lists with ranks from 1.

    ``rrf``: weight * k / (k + rank from 0); ``dbsf``: weighted scores stretched to 0..1 in
    their list (a list of one value: 1 if it is positive); ``weighted``: weighted scores.
    A key that a list repeats counts at its best rank.
    """
    how = how.strip().lower()
    if how not in ("rrf", "dbsf", "weighted"):
        raise ValueError(f"unknown fusion {how!r}")
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    weights = validated_weights(weights, sorted(weights))
    ranked = ranked.groupBy("query_id", "list", "key").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    ranked = weights_present(ranked, weights)
    if how == "dbsf":
        w = Window.partitionBy("query_id", "list")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        value: Column = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise((hi > 0).cast("double"))
    elif how == "weighted":
        value = F.col("score")
    else:
        value = F.lit(float(k)) / (k + F.col("rank") - 1)
    parts = ranked.withColumn("value", F.col("weight") * value)
    names = sorted(weights)
    sums = [F.coalesce(F.max(F.when(F.col("list") == n, F.col("value"))), F.lit(0.0)).alias(f"{n}_part") for n in names]
    out = parts.groupBy("query_id", "key").agg(*sums)
    total = sum((F.col(f"{n}_part") for n in names[1:]), F.col(f"{names[0]}_part"))
    return out.withColumn("score", F.round(total, DIGITS))


def provenance(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``query_id, key, from_list``: of the lists that hold a key the one of the highest weight, then of the highest name."""
    w = F.coalesce(*[F.when(F.col("list") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    return ranked.groupBy("query_id", "key").agg(F.max(F.struct(w.alias("w"), F.col("list"))).alias("m")).select("query_id", "key", F.col("m.list").alias("from_list"))


def hybrid_wins(per_mode: DataFrame) -> DataFrame:
    """One row, ``hybrid_wins``: whether hybrid has at least every other mode's recall and reciprocal rank (mode, recall, reciprocal_rank)."""
    h = per_mode.where("mode = 'hybrid'").select(F.col("recall").alias("r"), F.col("reciprocal_rank").alias("m"))
    return per_mode.crossJoin(h).agg(F.coalesce(F.bool_and((F.col("r") >= F.col("recall")) & (F.col("m") >= F.col("reciprocal_rank"))), F.lit(False)).alias("hybrid_wins"))  # one row


def overlap_score(query_terms: Column, document_terms: Column, coverage: float = 2.0, density: float = 1.0) -> Column:
    """Distinct common terms over the query's terms and over the document's."""
    q, d = F.array_distinct(query_terms), F.array_distinct(document_terms)
    common = F.size(F.array_intersect(q, d))
    return F.when(F.size(q) > 0, coverage * common / F.size(q) + F.when(F.size(d) > 0, density * common / F.size(d)).otherwise(0.0)).otherwise(0.0)


def overlap_scores(pool: DataFrame, asked: DataFrame, postings: DataFrame, coverage: float = 2.0, density: float = 1.0) -> DataFrame:
    """``query_id, key, score`` of a pool (query_id, key) by :func:`overlap_score`, from stored postings; asked: (query_id, term).

    A pool that is a written table goes to the postings where Spark finds it small; they are read once.
    """
    n_asked = asked.groupBy("query_id").agg(F.count("*").alias("n_asked"))
    own = postings.select("key", "term").join(pool, "key").join(asked.withColumn("met", F.lit(1)), ["query_id", "term"], "left")
    sizes = own.groupBy("query_id", "key").agg(F.count("met").alias("n"), F.count("*").alias("n_own"))
    all_ = pool.join(sizes, ["query_id", "key"], "left").join(n_asked, "query_id", "left").fillna(0, ["n", "n_asked", "n_own"])
    part = lambda w, of: F.when(F.col(of) > 0, w * F.col("n") / F.col(of)).otherwise(0.0)
    return all_.select("query_id", "key", F.round(part(coverage, "n_asked") + part(density, "n_own"), DIGITS).alias("score"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, groups: DataFrame | None = None) -> DataFrame:
    """Per query: recall, precision, hit at ``k`` and the reciprocal rank over all of ``ranked`` (query_id, key, rank).

    ``relevant`` holds (query_id, key); with ``groups`` (query_id, group) it holds (group, key), and what all queries of a group
    share is counted once, not for each of them.
    """
    by = "group" if groups is not None else "query_id"
    size = relevant.groupBy(by).agg(F.countDistinct("key").alias("n_relevant"))
    good_ones = relevant.select(by, "key").distinct().withColumn("hit", F.lit(True))
    if groups is not None:
        groups = groups.select("query_id", "group").distinct()
        size, ranked = groups.join(size, "group").drop("group"), ranked.join(groups, "query_id")
    hits = ranked.join(good_ones, [by, "key"], "left")
    good = F.col("hit") & (F.col("rank") <= k)
    per = hits.groupBy("query_id").agg(F.countDistinct(F.when(good, F.col("key"))).alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("best"))
    out = size.join(per, "query_id", "left").fillna(0, ["found"])
    return out.select(
        "query_id",
        (F.col("found") / F.col("n_relevant")).alias("recall"),
        (F.col("found") / F.lit(float(k))).alias("precision"),
        F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.col("found") > 0).cast("double").alias("hit"),
    )
