"""Documents joined by the Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

All documents order their n-grams alike, rare ones first, by a sketch of document frequencies whose size is fixed.  Of two similar
sets, any two prefixes that are l - 1 longer than the shortest possible share at least l n-grams.  Each document picks its own l: a
longer prefix has more postings to read, but the candidates that its postings can pay for shrink with l, and
the sketch says what the postings hold.  A pair of documents becomes a candidate once it shares as many n-grams as the smaller
of its two l asks for, counted within prefixes of that length.

An n-gram that many prefixes hold is not paired up: its documents become one candidate family.  Families are decided on
full sets in blocks of bounded size (see :mod:`.families`), so a group of thousands of copies
puts out no pairs.  Vertices are sets of n-grams, numbered once they are written: copies are one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, treesum
from .families import linked_within
from .minhash import _decide
from .scratch import NULL_ID, Scratch, pieces_of, real_id, slim, tidy, tidy_group
from .textvec import U, Words, arrow_texts, blocks, mix, set_hash, shingles

#: Cells of the frequency sketch, and those that travel together.  Frequencies order n-grams and estimate costs; no result rests on them.
CELLS, SLOT = 1 << 22, 1 << 16
#: The longest extension of a prefix.
MOST = 16
#: Prefixes holding an n-gram beyond which its documents are a family instead of pairs; within one task, fewer.
HOT, LOCAL = 64, 16
#: Candidates cost a pass over both sets: n-grams compared in the time of reading one posting.
COMPARED = 8
#: Postings that a task gathers before it deals them out, and the bytes of one.
GATHER, ENTRY = 1 << 20, 20
_SETS = "id long, th long, n_shingles long, h1 long, h2 long, need int, prefix binary"
_DEALT = "bucket int, kind int, x binary, y binary, z binary"
POSTINGS, EDGES = 0, 1
_SIZE_BITS = 22


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(7)) & U(CELLS - 1)


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
                np.add.at(total, _cells(np.concatenate(shingles(Words(texts), width))).astype(np.int64), 1)
        task, slots = TaskContext.get().partitionId(), [k for k in range(CELLS // SLOT) if total[k * SLOT : (k + 1) * SLOT].any()]
        data = [treesum.packed(total[k * SLOT : (k + 1) * SLOT]) for k in slots]
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(slots), pa.int32()), pa.array(slots, pa.int32()), pa.array(data, pa.binary())], names=["task", "slot", "data"])

    return run


def _frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """Four times the binary logarithm of each cell's frequency above the mean, in a byte."""
    rows = texts.select("text").mapInArrow(tidy(_counted(width)), treesum.SCHEMA)
    got = treesum.tree_sum(rows, rows.rdd.getNumPartitions(), SLOT)
    total = np.concatenate([*(np.zeros(SLOT, np.int64) if x is None else x for x in got), np.zeros(CELLS - SLOT * len(got), np.int64)])
    return np.round(4 * np.log2(np.maximum(total - total.mean(), 1))).astype(np.uint8)


def _chosen(df: np.ndarray, first: int, n: int, most: int) -> int:
    """The number of shared n-grams to ask for: least cost of reading postings and of comparing the candidates they can pay for."""
    ask = np.arange(1, most + 1)
    others = np.cumsum(df - 1)[first - 1 : first + most - 1]
    return int(ask[np.argmin(first + ask - 1 + others * (1 + n / (COMPARED * ask)))])


def _prefixes(width: int, num: int, den: int, levels: Broadcast, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, weight = levels.value, 2.0 ** (np.arange(256) / 4)
        for batch in batches:
            all_ids, all_ties = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            for numbers, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
                rows = []
                for k, s in zip(numbers, shingles(Words(texts), width), strict=True):
                    n, need, prefix = len(s), 0, b""
                    if n:
                        # A frequency class in front of the hash: one order of n-grams for all documents.
                        rank = level[_cells(s).astype(np.int64)].astype(U)
                        least = -(-num * n // den)
                        first, longest = n - least + 1, min(most, least)
                        order = np.sort((rank << U(56)) | (s >> U(8)))[: first + longest - 1]
                        need = _chosen(weight[(order >> U(56)).astype(np.int64)], first, n, longest)
                        prefix = order[: first + need - 1].tobytes()
                    rows.append((all_ids[k], all_ties[k], n, *set_hash(s), need, prefix))
                kinds = (pa.int64(),) * 5 + (pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "th", "n_shingles", "h1", "h2", "need", "prefix"])

    return run


def _runs(token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal tokens stand together, their leader drawn by hash, and where each run begins."""
    order = np.lexsort((mix(token ^ mix(row.astype(U))), token))
    t = token[order]
    return order, np.append(np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))), len(t)) if len(t) else np.zeros(1, np.int64)


def _postings(batch: pa.RecordBatch, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, row, and in 32 bits the set's size, the level of the token and the level that the row asks for."""
    prefix = batch.column("prefix").to_pylist()
    v, n, need = (batch.column(c).to_numpy() for c in ("v", "n_shingles", "need"))
    size = np.fromiter((len(p) // 8 for p in prefix), np.int64, len(prefix))
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    first = n + (-num * n // den) + 1
    level = np.maximum(1, place - first[of] + 2)
    meta = (np.minimum(n[of], (1 << _SIZE_BITS) - 1) << 10) | (level << 5) | need[of]
    return np.frombuffer(b"".join(prefix), U), v[of], meta.astype(np.uint32)


def _deal(num: int, den: int, buckets: int):
    def dealt(kind: int, by: np.ndarray, *data: np.ndarray) -> Iterator[tuple]:
        bucket = (mix(by.astype(U)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, data = bucket[order], [d[order] for d in data]
        cut = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(bucket[a]), kind, *[d[a:b].tobytes() for d in data], *[b""] * (3 - len(data))

    def flush(got: list[tuple]) -> pa.RecordBatch:
        token, row, meta = (np.concatenate(c) for c in zip(*got, strict=True))
        order, cut = _runs(token, row)
        token, row, meta = token[order], row[order], meta[order]
        run = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        hot = np.diff(cut)[run] > LOCAL
        lead = np.zeros(len(run), bool)
        lead[cut[:-1]] = True
        # An n-gram of many prefixes here: its leader goes on for all of them, marked by a level of 0.
        meta = np.where(hot, meta & np.uint32(~(31 << 5) & 0xFFFFFFFF), meta)
        a, b = row[hot & ~lead], row[cut[:-1]][run[hot & ~lead]]
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        some = ~hot | lead
        rows = [*dealt(POSTINGS, token[some], token[some], row[some], meta[some]), *dealt(EDGES, pair[:, 0], pair[:, 0], pair[:, 1])]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "x", "y", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            if batch.num_rows:
                got.append(_postings(batch, num, den))
                size += len(got[-1][0])
            if size >= GATHER:
                yield flush(got)
                got, size = [], 0
        if size:
            yield flush(got)

    return run


def _pairs(row: np.ndarray, meta: np.ndarray, cut: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows within each run that this n-gram counts for, and the number of n-grams they need.

    What two sets share lies in both prefixes, or behind the end of the one that ends first: of sizes n and k, ``least`` and
    ``last`` the numbers that J >= num / den asks of each, they share at most as many as in the prefixes and max(least, last) - need more.
    """
    size, a, b = np.diff(cut), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size[size > 1]):
        i, j = np.triu_indices(s, 1)
        begin = cut[:-1][size == s]
        a.append((begin[:, None] + i).reshape(-1))
        b.append((begin[:, None] + j).reshape(-1))
    a, b = np.concatenate(a), np.concatenate(b)
    m, o = meta[a].astype(np.int64), meta[b].astype(np.int64)
    n, k = m >> 10, o >> 10
    need = np.minimum(m & 31, o & 31)
    top = (1 << _SIZE_BITS) - 1
    unsure = (n == top) | (k == top)
    fits = (den * np.minimum(n, k) >= num * np.maximum(n, k)) | unsure
    keep = fits & (np.maximum((m >> 5) & 31, (o >> 5) & 31) <= need) & (row[a] != row[b])
    more = np.maximum(0, -(-num * (n + k) // (den + num)) + (-num * np.maximum(n, k) // den))
    need = need + np.where(unsure, 0, more)
    return np.minimum(row[a], row[b])[keep], np.maximum(row[a], row[b])[keep], need[keep]


def _meet(num: int, den: int):
    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        joined = lambda c, k, t: np.frombuffer(b"".join(v for v, w in zip(table.column(c).to_pylist(), kind, strict=True) if w == k), t)
        token, row, meta = joined("x", POSTINGS, U), joined("y", POSTINGS, np.int64), joined("z", POSTINGS, np.uint32)
        order, cut = _runs(token, row)
        row, meta, size = row[order], meta[order], np.diff(cut)
        marked = np.logical_or.reduceat((meta >> 5) & 31 == 0, cut[:-1]) if len(size) else np.zeros(0, bool)
        hot = (size > HOT) | marked
        run = np.repeat(np.arange(len(size)), size)
        a, b = row[hot[run]], row[cut[:-1]][run[hot[run]]]
        a, b = np.concatenate((a[a != b], joined("x", EDGES, np.int64))), np.concatenate((b[a != b], joined("y", EDGES, np.int64)))
        star = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        cold = ~hot[run]
        at = np.concatenate(([0], np.cumsum(size[~hot])))
        a, b, need = _pairs(row[cold], meta[cold], at, num, den)
        pair, where, count = np.unique(np.stack((a, b), axis=1), axis=0, return_inverse=True, return_counts=True)
        asked = np.zeros(len(pair), np.int64)
        asked[where.reshape(-1)] = need
        both = np.concatenate((star, pair))
        none = np.zeros(len(star), np.int64)
        return pa.table({"a": both[:, 0], "b": both[:, 1], "shared": np.concatenate((none, count)), "need": np.concatenate((none, asked))})

    return meet


def candidates(reps: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Edges ``a < b`` between the sets of ``(v, n_shingles, need, prefix)``: pairs that share enough of their prefixes, and
    a star for each n-gram that many prefixes hold."""
    n_postings = reps.agg(F.sum(F.octet_length("prefix")).cast("long")).first()[0] or 0
    buckets = pieces_of(reps.sparkSession, n_postings // 8 * ENTRY, 32 << 20)
    met = reps.mapInArrow(tidy(_deal(num, den, buckets)), _DEALT).groupBy("bucket").applyInArrow(tidy_group(_meet(num, den)), "a long, b long, shared long, need long")
    pairs = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    # A star's edge needs nothing.
    return scratch.keep(pairs.where("shared >= need").select("a", "b"), "candidates")


def _labelled(docs: DataFrame, width: int, num: int, den: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``(id, th, n_shingles, h1, h2)`` of each row, and ``(h1, h2, n_shingles, component)`` of each set of n-grams."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngramjoin")
    texts = slim(docs).withColumn("th", F.xxhash64("text"))
    levels = spark.sparkContext.broadcast(_frequencies(texts, width))
    sets = scratch.keep(texts.mapInArrow(tidy(_prefixes(width, num, den, levels, most)), _SETS), "sets")
    # Documents with one set are one vertex, spoken for by the smallest id.
    classes = sets.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("id", "th", "need", "prefix")).alias("s"))
    reps = scratch.keep(classes.select(F.monotonically_increasing_id().alias("v"), "h1", "h2", "n_shingles", "s.*"), "reps")
    rows = scratch.keep(sets.drop("need", "prefix"), "rows")
    scratch.drop("sets")

    family = graph.components(candidates(reps.select("v", "n_shingles", "need", "prefix"), scratch, num, den), scratch, "family")
    members = family.select("id").union(family.select(F.col("component").alias("id"))).distinct()
    spoken = members.join(reps.select(F.col("v").alias("id"), F.col("id").alias("doc"), "th"), "id").select(F.col("id").alias("v"), "doc", "th")
    data = texts.withColumnRenamed("id", "doc").join(spoken, ["doc", "th"]).select(F.col("v").alias("id"), F.col("text").cast("binary").alias("data"))
    links = linked_within(family, scratch.keep(data, "data"), _decide(width, num, den), scratch, "pairs-of")
    found = graph.components(links, scratch, "linked", contracted=True).withColumnRenamed("id", "member")

    label = reps.select("v", "h1", "h2", "n_shingles", "id").join(found, F.col("v") == F.col("member"), "left").withColumn("vertex", F.coalesce("component", "v"))
    best = label.groupBy("vertex").agg(F.min("id").alias("least"))
    return rows, scratch.keep(label.join(best, "vertex").select("h1", "h2", "n_shingles", F.col("least").alias("component")), "label")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, most: int = MOST) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Two documents link if their sets of distinct ``width``-word shingles (words lower-cased in A-Z; a shorter text is one
    shingle) have an exact Jaccard similarity of at least ``num / den``; ``component_id`` is the smallest ``doc_id`` reachable by
    links, itself included.  A prefix asks for at most ``most`` (31 or fewer) shared shingles.  A null or empty text, or one
    without words, has no shingle and is linked with nothing.  Rows that repeat a ``doc_id`` are rows of their own, linked by their
    texts only.  A null ``doc_id`` counts as smaller than all others.  Other columns are ignored, whatever their names; an
    empty table has no rows.
    """
    rows, label = _labelled(docs, width, num, den, most)
    out = rows.join(label, ["h1", "h2", "n_shingles"], "left")
    comp = F.coalesce("component", "id")
    return out.select(real_id().alias("doc_id"), "n_shingles", F.when(comp != F.lit(NULL_ID), comp).alias("component_id"))
