"""Near-duplicate documents: tensored MinHash tables, exact confirmation, components.

Two collections of ``groups`` short minhash groups are computed; a table key
combines one group of either collection, so ``groups**2`` tables cost only
``2 * groups`` groups of minhashes.  Of a key's documents each is held against one leader:
likely pairs join a family, and documents that a leader rejects meet again under keys of twice
the length, where all that meet join.  Within a family every pair that is not connected yet is decided
on full shingle sets by blocked matrix products, in tasks of bounded size.

Vertices are shingle sets, numbered once they are written, not document ids: rows that
repeat an id are as far apart as their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .collide import colliding
from .families import linked_within
from .scratch import NULL_ID, Scratch, pieces_of, real_id, slim, tidy
from .textvec import U, Words, arrow_texts, blocks, minhashes, mix, set_hash, shingles

#: Minhash groups of a collection, and minhashes of a group: a pair of similarity s misses both
#: collections' tables with probability below 2 * (1 - s**WIDTH)**GROUPS, 7e-5 at 0.85.
GROUPS, WIDTH = 8, 2
#: Share of equal minhashes from which two colliding documents belong to one family.
FAMILY = 0.5
#: Bytes that one entry of a table takes.
_ENTRY = 16
_SIG = "id long, th long, n_shingles long, h1 long, h2 long, sig binary"


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_ties = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            for numbers, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
                sets = shingles(Words(texts), width)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                full = np.flatnonzero(size)
                flat = np.concatenate([sets[k] for k in full]) if len(full) else np.zeros(0, U)
                sig = minhashes(flat, np.concatenate(([0], np.cumsum(size[full])[:-1])) if len(full) else full, 2 * GROUPS * WIDTH, 11)
                packed = dict(zip(full.tolist(), sig, strict=True))
                h = [set_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([all_ids[k] for k in numbers], pa.int64()), pa.array([all_ties[k] for k in numbers], pa.int64()), pa.array(size), pa.array([x for x, _ in h], pa.int64()), pa.array([y for _, y in h], pa.int64()),
                        pa.array([packed[k].tobytes() if k in packed else b"" for k in range(len(sets))], pa.binary()),
                    ],
                    names=["id", "th", "n_shingles", "h1", "h2", "sig"],
                )

    return run


def _table_keys(long: bool):
    """The tensored keys: every group of the first collection with every group of the second; ``long``: every two neighbouring groups of either."""

    def keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = batch.column("id").to_numpy()
        step = 20_000
        for lo in range(0, len(ids), step):
            some = ids[lo : lo + step]
            sig = np.frombuffer(b"".join(batch.column("sig").slice(lo, step).to_pylist()), np.uint32).reshape(len(some), 2, GROUPS, WIDTH)
            group = np.zeros(sig.shape[:3], U)
            for k in range(WIDTH):
                group = mix(group * U(0x100000001B3) + sig[..., k].astype(U) + U(k + 1))
            if long:
                group = mix(group + np.roll(group, 1, axis=2) * U(0xC2B2AE3D27D4EB4F))
            for i in range(GROUPS):
                for j in range(GROUPS):
                    yield mix(group[:, 0, i] + group[:, 1, j] * U(0x9E3779B97F4A7C15) + U(i * GROUPS + j + 1)), some

    return keys


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of documents with enough equal minhashes, contracted (kind 0), and loops for those with too few (kind 1)."""
    n = 2 * GROUPS * WIDTH
    for x in batches:
        s, t = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint32).reshape(-1, n) for c in ("sa", "sb"))
        keep = (s == t).sum(axis=1) >= FAMILY * n
        u, v = x.column("a").to_numpy(), x.column("b").to_numpy()
        a, b = graph.forest(u[keep], v[keep])
        far = np.unique(np.concatenate((u[~keep], v[~keep])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, far))), pa.array(np.concatenate((b, far)))], names=["a", "b"])


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set the smallest one it is connected with, by pairs of a left and a right set with
    ``den * |intersection| >= num * |union|``.  All pairs are decided, by matrix products; none is put out."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.ones(len(flat), bool)
    head[1:] = flat[1:] != flat[:-1]
    term = np.cumsum(head) - 1
    often = np.bincount(term) > 1
    keep = often[term]
    owner, term = owner[keep], (np.cumsum(often) - 1)[term[keep]]
    n_terms, step = int(often.sum()), 1024
    both = np.zeros((len(left), len(right)), np.float32)
    where_l, where_r = np.full(len(sets), -1), np.full(len(sets), -1)
    where_l[left], where_r[right] = np.arange(len(left)), np.arange(len(right))
    for lo in range(0, n_terms, step):
        a, b = np.searchsorted(term, (lo, lo + step))
        o, t = owner[a:b], term[a:b] - lo
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        in_l, in_r = where_l[o] >= 0, where_r[o] >= 0
        x[where_l[o[in_l]], t[in_l]] = 1
        y[where_r[o[in_r]], t[in_r]] = 1
        both += x @ y.T
    # Sizes are far below 2**24, so the products are whole numbers.
    link = (den + num) * both.astype(np.int64) >= num * (size[left][:, None] + size[right][None, :])
    label = np.arange(len(sets), dtype=np.int32)
    far = np.int32(len(sets))
    while True:
        before = label.copy()
        np.minimum.at(label, left, np.where(link, label[right][None, :], far).min(axis=1, initial=far))
        np.minimum.at(label, right, np.where(link, label[left][:, None], far).min(axis=0, initial=far))
        if (label == before).all():
            return label


def _decide(width: int, num: int, den: int):
    def decide(texts: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sets: list[np.ndarray] = []
        for _, some in blocks(list(range(len(texts))), texts):
            sets += shingles(Words(some), width)
        return _linked(sets, left, right, num, den)

    return decide


def _labelled(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``(id, th, n_shingles, h1, h2)`` of each row, and ``(h1, h2, n_shingles, component, kept)`` of each shingle set:
    the smallest id reachable, and the struct ``(id, th, copies)`` of the one row that speaks for the component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = slim(docs).withColumn("th", F.xxhash64("text"))
    sigs = scratch.keep(texts.mapInArrow(tidy(_signatures(width)), _SIG), "sigs")
    # Documents with one shingle set are one vertex.
    copies = sigs.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles", "id", "th").agg(F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = copies.groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("id", "th", "copies", "sig")).alias("s"))
    reps = classes.select(F.monotonically_increasing_id().alias("v"), "h1", "h2", "n_shingles", F.struct("s.id", "s.th", "s.copies").alias("one"), F.col("s.sig").alias("sig"))
    reps = scratch.keep(reps, "reps")

    sig = reps.select(F.col("v").alias("id"), "sig")
    buckets = pieces_of(spark, sig.count() * GROUPS * GROUPS * _ENTRY)
    pairs = scratch.keep(colliding(sig, _table_keys(False), buckets), "pairs")
    near = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    near = scratch.keep(near.select("a", "b", "sa", "sb").mapInArrow(tidy(_alike), "a long, b long"), "near")
    again = sig.join(near.where("a = b").select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    edges = near.where("a <> b").union(colliding(again, _table_keys(True), buckets))
    family = graph.components(edges, scratch, "family", contracted=True)

    members = family.select("id").union(family.select(F.col("component").alias("id"))).distinct()
    spoken = members.join(reps.select(F.col("v").alias("id"), F.col("one.id").alias("doc"), F.col("one.th").alias("th")), "id").select(F.col("id").alias("v"), "doc", "th")
    data = texts.withColumnRenamed("id", "doc").join(spoken, ["doc", "th"]).select(F.col("v").alias("id"), F.col("text").cast("binary").alias("data"))
    links = linked_within(family, scratch.keep(data, "data"), _decide(width, num, den), scratch, "pairs-of")
    found = graph.components(links, scratch, "linked", contracted=True)

    label = reps.select("v", "h1", "h2", "n_shingles", "one").join(found, F.col("v") == F.col("id"), "left")
    label = label.select("h1", "h2", "n_shingles", "one", F.coalesce("component", "v").alias("vertex"))
    best = label.groupBy("vertex").agg(F.min("one").alias("kept"))
    label = label.join(best, "vertex").select("h1", "h2", "n_shingles", F.col("kept.id").alias("component"), "kept", F.col("one") == F.col("kept"))
    return sigs.drop("sig"), scratch.keep(label.toDF("h1", "h2", "n_shingles", "component", "kept", "speaks"), "label")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if their sets of distinct ``width``-word shingles
    (words lower-cased in A-Z; a shorter text is one shingle) have an exact
    Jaccard similarity of at least ``num / den``; ``component_id`` is the
    smallest ``doc_id`` reachable, ``kept`` marks it.  A null or empty text, or one without
    words, has no shingle and is linked with nothing.  Rows that repeat a
    ``doc_id`` are rows of their own, linked by their texts only.  A null ``doc_id`` counts as
    smaller than all others.  Other columns are ignored, whatever their names; an empty table has no rows.
    """
    rows, label = _labelled(docs, width, num, den)
    out = rows.join(label.select("h1", "h2", "n_shingles", "component"), ["h1", "h2", "n_shingles"], "left")
    # Sets without shingles have no class; each of their rows stands alone.
    comp = F.coalesce("component", "id")
    return out.select(real_id().alias("doc_id"), "n_shingles", F.when(comp != F.lit(NULL_ID), comp).alias("component_id"), (F.col("id") == comp).alias("kept"))


def unique_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one row is kept of each component of linked documents.

    It is a row of the smallest ``doc_id`` in the component (of several by a hash of their
    texts, then by a hash of their other columns).  Rows without words stay, all of them, and so do
    rows that share no more than their id with another.  A null id is the smallest.
    """
    _, label = _labelled(docs, width, num, den)
    kept = label.where("speaks").select("kept.id", "kept.th", "kept.copies").distinct()
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("worded", F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("th", F.xxhash64("text")).drop("text")
    mine = rows.where("worded").join(kept, ["id", "th"])
    plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    several = mine.where("copies > 1").groupBy("id", "th").agg(F.min_by("row", F.xxhash64(*[F.col(f"row.{c}") for c in plain])).alias("row"))
    return rows.where("not worded").select("row.*").unionAll(mine.where("copies = 1").select("row.*")).unionAll(several.select("row.*"))
