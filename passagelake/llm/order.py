"""Token ids in training order: packed sequences, a keyed permutation, fixed-stride shards.

Documents' token ids, each closed by an end mark, are laid end to end and cut
into sequences of ``length`` ids.  A keyed Feistel network over the next
even power of two, walked along its cycles until it lands below the number of
sequences, gives each sequence its global slot.  Slots are dealt to shards by
range; a shard is a file of records of one size, so slot s of a shard of S slots
is the record (s mod S), and reading can begin or resume anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches, pieces_of, slim, tidy
from .textvec import U, mix
from .tokens import VOCABULARY, Coder, code_points, lots, pretoken_starts

END = 50256
ROUNDS = 6
SEQUENCE = 1024
#: Slots of a shard: files of 16 MB at 1,024 ids a sequence, sorted by one task each.
PER_SHARD = 8192


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of ``index``: a permutation of 0..n-1 that ``key`` chooses."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = U((1 << half) - 1), U(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key & (2**64 - 1)))
    out = index.astype(U)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right * U(0xD6E8FEB86659FD93) + k) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= U(n)]
    return out.astype(np.int64)


def _encode(vocabulary: str):
    """``(piece, inner, n, tokens)`` of each text: its ids, closed by an end mark, and where they start among those of its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, upto_here = Coder(vocabulary), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in lots(texts):
                joined = "".join(texts[lo:hi])
                flat = code_points(joined)
                size = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
                first = np.cumsum(size) - size
                starts = pretoken_starts(flat, first[size > 0])
                ids, n = coder.encoded(joined, flat, starts) if len(starts) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
                upto = np.concatenate(([0], np.cumsum(n)))
                cut = upto[np.searchsorted(starts, np.append(first, len(flat)))]
                ids = np.insert(ids, cut[1:], END)
                cut = cut + np.arange(len(cut))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("piece").slice(lo, hi - lo), pa.array(cut[:-1] + upto_here), pa.array(np.diff(cut)), pa.array([ids[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                    names=["piece", "inner", "n", "tokens"],
                )
                upto_here += int(cut[-1])

    return run


def _pieces(length: int, key: int, total: int):
    """Each text's ids cut at the ends of sequences: ``(index, slot, at, tokens)``, ``at`` the place in the sequence."""
    n = -(-total // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = batch.column("at").to_numpy(), batch.column("tokens").to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data)) // 2
            first = at // length
            count = (at + size - 1) // length - first + 1
            text = np.repeat(np.arange(len(data)), count)
            index = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(index * length, at[text])
            stop = np.minimum((index + 1) * length, (at + size)[text])
            lo, hi = (2 * (x - at[text]) for x in (begin, stop))
            tokens = [data[k][x:y] for k, x, y in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(feistel(index, n, key)), pa.array((begin - index * length).astype(np.int32)), pa.array(tokens, pa.binary())], names=["index", "slot", "at", "tokens"])

    return run


_RECORD = "slot long, sequence long, shard long, n_tokens int, record binary"
_DIGEST = "slot long, sequence long, shard long, n_tokens int, sha256 string"


def _assemble(length: int, per_shard: int, digest: bool):
    names = [c.split()[0] for c in (_DIGEST if digest else _RECORD).split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string() if digest else pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, index, got = None, None, []
        rows: list[tuple] = []

        def record():
            data = b"".join(got)
            n = len(data) // 2
            data += np.full(length - n, END, np.uint16).tobytes()
            rows.append((slot, index, slot // per_shard, n, hashlib.sha256(data).hexdigest() if digest else data))

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for s, i, t in zip(batch.column("slot").to_pylist(), batch.column("index").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if s != slot:
                    if got:
                        record()
                    slot, index, got = s, i, []
                got.append(t)
            if len(rows) >= 1000:
                yield batch_of()
                rows.clear()
        if got:
            record()
        if rows:
            yield batch_of()

    return run


def _laid_out(texts: DataFrame, scratch: Scratch, vocabulary: str) -> DataFrame:
    """``(piece, inner, n, tokens)``, written: texts in order of (id, hash of the text), a range of them for each task.

    A task sums up its own sizes, so texts are dealt once and their ids stay where they lie.
    """
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # Rows of one id and text may lie in several ranges, in any order.
    ranges = texts.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = ranges.repartitionByRange(pieces_of(scratch.spark, total), "id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    tokens = dealt.select(F.spark_partition_id().alias("piece"), "text").mapInArrow(tidy(_encode(vocabulary)), "piece int, inner long, n long, tokens binary")
    return scratch.keep(tokens, "tokens")


def training_order(docs: DataFrame, key: int = 1, length: int = SEQUENCE, vocabulary: str = VOCABULARY, per_shard: int = PER_SHARD, digest: bool = False) -> DataFrame:
    """``slot, sequence, shard, n_tokens, record``: every sequence of the corpus, in order of slots within each partition.

    A partition holds one shard of ``per_shard`` slots, whatever the size of the corpus.  ``record`` is ``2 * length`` bytes of
    little-endian uint16; the last sequence is filled with end marks, which
    ``n_tokens`` does not count; with ``digest`` a column ``sha256`` of it takes its
    place, made as records are assembled.  The corpus is laid out in order of ids (null first), rows of
    one id by a hash of their texts, so the result is the same for any partitioning of the input.
    A null or empty text is one end mark, a text of any length spans as many sequences as it needs; other
    columns are ignored, whatever their names; an empty table has no rows.
    """
    spark = docs.sparkSession
    tokens = _laid_out(slim(docs), Scratch(spark, "order", free=True), vocabulary)
    sizes = tokens.groupBy("piece").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    base = sizes.selectExpr("piece", "sum(n) over (order by piece) - n as base")  # a row for each range
    placed = tokens.join(F.broadcast(base), "piece").select((F.col("base") + F.col("inner")).alias("at"), "tokens")
    pieces = placed.select("at", "tokens").mapInArrow(tidy(_pieces(length, key, total)), "index long, slot long, at int, tokens binary")
    shards = max(1, -(-total // length // per_shard))
    dealt = pieces.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("slot", "at")
    return dealt.select("slot", "index", "tokens").mapInArrow(tidy(_assemble(length, per_shard, digest)), _DIGEST if digest else _RECORD)


def write_shards(records: DataFrame, path: str, length: int = SEQUENCE) -> int:
    """Write each shard as one raw file of fixed-stride records, in order of slots; the stride in bytes.

    A record is its ids and one line feed, so the text writer's commit protocol
    (a lost task leaves nothing behind) applies and any store Spark can write will do.
    """
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    return 2 * length + 1


def read_shard(spark, file: str, stride: int, first: int = 0):
    """Records of a shard file from its ``first`` record on, as (place, uint16 ids) in order."""
    rdd = spark.sparkContext.binaryRecords(file, stride).zipWithIndex().filter(lambda x: x[1] >= first)
    return rdd.map(lambda x: (x[1], np.frombuffer(x[0][:-1], np.uint16)))


def shard_records(spark, path: str, length: int = SEQUENCE, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot, shard, place, sha256`` of every record in the shard files below ``path``, read from the files.

    The task that wrote shard s named its file ``part-<s>``; the place in the file gives the slot.
    """
    bound_batches(spark)
    stride = 2 * length + 1
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    files = files.select(F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shard in enumerate(batch.column("shard").to_pylist()):
                data = memoryview(batch.column("content")[k].as_buffer())
                place = np.arange(len(data) // stride)
                sha = [hashlib.sha256(data[x : x + stride - 1]).hexdigest() for x in (place * stride).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard * per_shard + place), pa.array(np.full(len(place), shard)), pa.array(place), pa.array(sha, pa.string())], names=["slot", "shard", "place", "sha256"])

    return files.mapInArrow(tidy(run), "slot long, shard long, place long, sha256 string")


def shards_in_order(docs: DataFrame, path: str, length: int = SEQUENCE, per_shard: int = PER_SHARD, **options) -> DataFrame:
    """Write the corpus as shards below ``path``; :func:`shard_records` of what was written."""
    write_shards(training_order(docs, length=length, per_shard=per_shard, **options), path, length)
    return shard_records(docs.sparkSession, path, length, per_shard)


def order_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per sequence: ``slot, sequence, shard, n_tokens, sha256`` of its record, without writing any."""
    return training_order(docs, digest=True, **options)
