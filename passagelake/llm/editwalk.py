"""Document fingerprints by a randomised edit embedding.

A shared random walk reads each text: at step j it stands on a character c and
goes on by one character if bit (j, c) of a shared random function is set.  Two
texts a few edits apart are read in step again soon after each edit, so the
edit distance becomes a Hamming distance between walks.  Walks begin anew
every ``SPAN`` characters, which bounds a walk's length and lets all walks of
a batch take each step together.  A fingerprint keeps ``SAMPLES`` symbols of the
walk, at positions that depend on the text's length alone and rarely change with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .collide import colliding
from .families import linked_within
from .scratch import Scratch, part_count, pieces_of, real_id, slim
from .textvec import U, mix, seeds

#: Characters of one walk.
SPAN = 2048
#: Symbols of a fingerprint, one byte each, and characters that a symbol covers.
SAMPLES, GRAM = 128, 4
#: Band width in symbols.
BAND = 4
#: Characters that take their steps together.
TOGETHER = 2 << 20


def _records() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sample the positions at which a shared random order has a new minimum (up to 2**40 steps)."""
    rng = np.random.Generator(np.random.PCG64(97))
    out = []
    for _ in range(SAMPLES):
        # The minima of a random order over 0, 1, 2, ...: from a minimum at p the next is uniform in its scale.
        at = [0]
        while at[-1] < 1 << 40:
            at.append(max(at[-1] + 1, int(np.ceil((at[-1] + 1) / max(rng.random(), 1e-9))) - 1))
        out.append(np.array(at, np.int64))
    return out


_SAMPLE_AT = _records()


def sample_positions(steps: np.ndarray) -> np.ndarray:
    """Positions below ``steps``, one for each sample: uniform, and the same for most lengths nearby."""
    return np.stack([at[np.searchsorted(at, np.maximum(steps, 1), "left") - 1] for at in _SAMPLE_AT], axis=1)


def fingerprints(texts: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (n, SAMPLES) of texts given as arrays of code points."""
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or k == len(texts) - 1:
            out[lo : k + 1] = _walk(texts[lo : k + 1])
            lo, size = k + 1, 0
    return out


def _walk(texts: list[np.ndarray]) -> np.ndarray:
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(n + GRAM) - n - GRAM
    gap = np.zeros(GRAM, np.uint32)
    flat = np.concatenate([*(x for t in texts for x in (t, gap)), gap]).astype(np.uint32)
    gram = np.zeros(len(flat) - GRAM, U)
    for k in range(GRAM):
        gram = gram * U(0x100000001B3) + flat[k : len(gram) + k]
    symbol = (mix(gram) >> U(56)).astype(np.uint8)
    walks = -(-n // SPAN)
    owner = np.repeat(np.arange(len(texts)), walks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(walks) - walks, walks)
    start = base[owner] + nth * SPAN
    length = np.minimum(SPAN, n[owner] - nth * SPAN)
    # Wanted symbols: (walk, step) of each sample, by step.
    at = sample_positions(2 * n)
    text_of = np.repeat(np.arange(len(texts)), SAMPLES)
    at = at.ravel()
    first = np.cumsum(walks) - walks
    there = n[text_of] > 0
    walk = np.where(there, first[text_of] + np.minimum(at // (2 * SPAN), walks[text_of] - 1), 0)
    step = at - (at // (2 * SPAN)) * 2 * SPAN
    want = np.flatnonzero(there)
    want = want[np.argsort(step[want], kind="stable")]
    steps = step[want]
    cut = np.searchsorted(steps, np.arange(2 * SPAN + 1))
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    here, stop = start[order], (start + length)[order]
    alive_at = np.searchsorted(-length[order], -(np.arange(2 * SPAN + 1) // 2), "left")
    cls = (flat * np.uint32(0x9E3779B1)) >> np.uint32(16)
    result = np.zeros(len(texts) * SAMPLES, np.uint8)
    salt = (seeds(2 * SPAN, 5) >> U(33)).astype(np.uint32) | np.uint32(1)
    end = stop.copy()
    for j in range(2 * SPAN):
        a, b = cut[j], cut[j + 1]
        if b > a:
            who = want[a:b]
            p = here[place[walk[who]]]
            inside = p < end[place[walk[who]]]
            result[who] = np.where(inside, symbol[np.minimum(p, len(symbol) - 1)], (j * 37 + 11) & 255)
        m = alive_at[j]
        if not m or a >= len(want) and b >= len(want):
            break
        c = cls[here[:m]]
        c += np.uint32(j)
        c *= salt[j]
        c >>= np.uint32(31)
        here[:m] += c
        np.minimum(here[:m], end[:m], out=here[:m])
    return result.reshape(len(texts), SAMPLES)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal symbols, less what chance makes equal; 1 for equal fingerprints."""
    same = (x == y).mean(axis=-1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)


def _sha(points: np.ndarray) -> str:
    return hashlib.sha256(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()


def edited(text: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``text`` with its last half replaced by the first characters of ``after``."""
    half = len(text) // 2
    return np.concatenate((text[: len(text) - half], after[:half]))


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list[int], texts: list[np.ndarray], after: list[np.ndarray]) -> pa.RecordBatch:
    """``texts[k]`` is followed by ``after[k]``, which is ``texts[k + 1]`` wherever there is one."""
    new = [edited(t, a) for t, a in zip(texts, after, strict=True)]
    n = len(texts)
    fp = fingerprints([*texts, after[-1], *new])
    own, nxt, ed = fp[:n], fp[1 : n + 1], fp[n + 1 :]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([_sha(t) for t in new]), pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in ed]), pa.array(likeness(own, ed)), pa.array(likeness(own, nxt))],
        names=[c.split()[0] for c in _OUT.split(", ")],
    )


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition in order: every document whose next one is in the partition."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(_points(t))
            size += len(texts[-1])
            if size >= TOGETHER and len(ids) > 1:
                yield _compare(ids[:-1], texts[:-1], texts[1:])
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield _compare(ids[:-1], texts[:-1], texts[1:])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last row of a partition in order."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    if first is not None:
        for k, x in enumerate((first, last)):
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("text"), pa.array([k], pa.int32())], names=["id", "text", "end"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            t, a = (_points(batch.column(c).cast(pa.binary())[k].as_py()) for c in ("text", "after"))
            yield _compare([batch.column("id")[k].as_py()], [t], [a])


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Documents are put in order of id (null first; rows of one id by a hash of their text); the edited
    text replaces the last floor(n/2) code points by the first as many of the
    next document, after the last by those of the first.  Texts are dealt out
    by ranges of ids once; a partition's rows meet their successors there, and
    only the partitions' ends are joined across.  A null text is empty; an empty
    text's fingerprint is all zero; a single document follows itself; a text of any length is
    walked whole.  Other columns are ignored, whatever their names; an empty table has no rows.
    """
    parts = part_count(docs.sparkSession)
    dealt = slim(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    inner = dealt.mapInArrow(_inner, _OUT)
    ends = dealt.mapInArrow(_ends, "id long, text string, end int").withColumn("pid", F.spark_partition_id())
    firsts, lasts = ends.where("end = 0"), ends.where("end = 1")
    # One number for each range that has rows; the range after the last is the first.
    ranks = firsts.select("pid").selectExpr("pid", "lead(pid) over (order by pid) as next", "first(pid) over (order by pid) as head")
    ranks = ranks.select("pid", F.coalesce("next", "head").alias("next"))
    across = lasts.join(ranks, "pid").join(firsts.select(F.col("pid").alias("next"), F.col("text").alias("after")), "next").select("id", "text", "after")
    out = inner.unionByName(across.mapInArrow(_across, _OUT))
    return out.select(real_id().alias("doc_id"), *[c for c in out.columns if c != "id"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_points(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        fp = fingerprints(texts)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in fp], pa.binary())], names=["id", "fp"])


def _bands(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids = batch.column("id").to_numpy()
    fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(len(ids), SAMPLES // BAND, BAND)
    key = np.ascontiguousarray(fp).view(np.uint32)[:, :, 0].astype(U)
    for k in range(key.shape[1]):
        yield mix(key[:, k] + U((k + 1) << 32)), ids


def _near(least: float):
    def decide(data: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        fp = np.frombuffer(b"".join(data), np.uint8).reshape(-1, SAMPLES)
        a, b = [], []
        for k in left.tolist():
            near = right[likeness(fp[k], fp[right]) >= least]
            a.append(np.full(len(near), k))
            b.append(near)
        label = np.arange(len(data))
        member, smallest = graph.forest(np.concatenate(a), np.concatenate(b)) if a else (label[:0], label[:0])
        label[member] = smallest
        return label

    return decide


def near_by_edits(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, component_id``: documents joined by bit-sampled bands whose fingerprints are verified to be ``least`` alike.

    One row for each row of ``docs``; ``component_id`` is the smallest id reachable.  Equal
    fingerprints form one class; classes connected by shared bands are one family, whose pairs
    are all decided, in blocks.  Null and empty texts stand alone; rows that repeat an id go by their
    texts; a null id is the smallest; an empty table has no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "edits")
    fp = scratch.keep(slim(docs).mapInArrow(_prints, "id long, fp binary"), "prints")
    classes = fp.where(F.col("fp") != F.lit(bytes(SAMPLES))).groupBy("fp").agg(F.min("id").alias("least"))
    reps = scratch.keep(classes.select(F.monotonically_increasing_id().alias("id"), "fp", "least"), "reps")
    buckets = pieces_of(spark, reps.count() * (SAMPLES // BAND) * 16)
    family = graph.components(colliding(reps.select("id", "fp"), _bands, buckets), scratch, "family")
    links = linked_within(family, reps.select("id", F.col("fp").alias("data")), _near(least), scratch, "pairs-of")
    found = graph.components(links, scratch, "near", contracted=True)
    label = reps.join(found, "id", "left").select("fp", "least", F.coalesce("component", "id").alias("vertex"))
    best = label.groupBy("vertex").agg(F.min("least").alias("component"))
    out = fp.join(label.join(best, "vertex").select("fp", "component"), "fp", "left").select("id", F.coalesce("component", "id").alias("component"))
    return out.select(real_id().alias("doc_id"), real_id("component").alias("component_id"))
