"""Postings in blocks of whole documents: texts are cut and counted in Arrow, and documents are scored where their words lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx

#: Bytes of text and documents in a block; a longer document is a block of its own.
TEXT, DOCUMENTS = 1 << 19, 1 << 12
#: Bytes of a row group of blocks, which a reader holds at once.
GROUP = 8 << 20
#: Sums of documents and queries that a task holds at once, and parts of these.
CELLS = 1 << 21
#: Words of blocks whose counts a task adds up at once.
MERGED = 1 << 21
#: Bytes that a Python task is handed at once.
BATCH = 8 << 20

#: By byte: its small letter; whether it is a sign of words (1), joins two of them (2), or neither (0).
_LOW = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_SIGN = bytes(1 if chr(b).isalnum() and b < 128 else 2 * (chr(b) in "'-_") for b in range(256))
#: By code point: the letter that an accented one of two bytes is without its marks, 0 for all others.
_BARE = np.zeros(0x800, np.uint8)
for _c in range(0xC0, 0x180):
    _BARE[_c] = ord(tx._PLAIN.get(chr(_c).lower(), "\0"))
_SHARP = ord("ß")
_STOP = pa.array(tx.STOPWORDS)
#: Packed numbers of a block: its documents' lengths, its words' documents, its documents' distinct words, and each posting's word and count.
_NUMBERS = ("lengths", "found", "own", "word", "tf")


def _simple(raw: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that end at ``upto`` without their accents, where these end now, and which texts have other signs than that; they are blanked."""
    first = np.flatnonzero(raw >= 0xC0)
    hard = np.zeros(len(upto), bool)
    if not len(first):
        return raw, upto, hard
    code = ((raw[first].astype(np.int64) & 0x1F) << 6) | (raw[first + 1] & 0x3F)
    bare = np.where(raw[first] < 0xE0, _BARE[code], 0)
    sharp = (raw[first] < 0xE0) & (code == _SHARP)
    text = np.searchsorted(upto, first, "right")
    hard[text[(bare == 0) & ~sharp]] = True
    raw = raw.copy()
    raw[first] = np.where(sharp, ord("s"), bare)
    raw[first[sharp] + 1] = ord("s")
    stay = np.ones(len(raw), bool)
    stay[first[~sharp] + 1] = False
    begin = np.concatenate(([0], upto[:-1]))
    for k in np.flatnonzero(hard):
        raw[begin[k] : upto[k]] = 10
    return raw[stay], np.concatenate(([0], np.cumsum(stay)))[upto], hard


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of texts as :func:`text.any_words` has them: distinct words, and for each occurrence its word and its text."""
    texts = texts.fill_null("")
    n = len(texts)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts), "\n")[0].as_buffer()
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    raw = np.concatenate((np.frombuffer(joined, np.uint8), np.array([10], np.uint8)))
    raw, upto, hard = _simple(raw, upto)
    raw = raw.tobytes()
    low, sign = np.frombuffer(raw.translate(_LOW), np.uint8), np.frombuffer(raw.translate(_SIGN), np.uint8)
    inside = sign == 1
    joint = np.flatnonzero(sign[1:-1] == 2) + 1
    inside[joint[(sign[joint - 1] == 1) & (sign[joint + 1] == 1)]] = True
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the last sign is no letter
    edge = np.concatenate(([0], edge)) if inside[0] else edge
    start, end = edge[::2], edge[1::2]
    data, offsets = low[inside], np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    words, word = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(np.searchsorted(start, upto), prepend=0))
    good = pc.and_(pc.invert(pc.is_in(words, value_set=_STOP)), pc.or_(pc.greater(pc.binary_length(words), 1), pc.match_substring_regex(words, "^[0-9]$")))
    good = good.to_numpy(zero_copy_only=False).astype(bool)
    stay = good[word]
    words, word, text = words.filter(pa.array(good)), (np.cumsum(good) - 1)[word[stay]], text[stay]
    if hard.any():
        other = {int(k): tx.terms(texts[int(k)].as_py()) for k in np.flatnonzero(hard)}
        more = pa.array([w for t in other.values() for w in t], pa.string())
        both = pc.unique(pa.concat_arrays([words, more]))
        word = np.concatenate((word, pc.index_in(more, value_set=both).to_numpy(zero_copy_only=False).astype(np.int64)))  # the first ones keep their numbers
        text = np.concatenate((text, np.repeat(np.array(list(other), np.int64), [len(t) for t in other.values()])))
        words = both
    return words, word, text


def packed(values: np.ndarray) -> pa.Array:
    """Whole numbers in as few bytes each as the greatest needs: Spark copies them whole instead of one by one."""
    return pa.array([values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()], pa.binary())


def unpacked(column: pa.Array, k: int, n: int) -> np.ndarray:
    raw = column[k].as_buffer()
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def listed(values: pa.Array) -> pa.Array:
    """All values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(keys: pa.Array, words: pa.Array, lengths: np.ndarray, doc: np.ndarray, word: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """One block: documents' keys and lengths, distinct words, and of each posting, in order of documents, its document, word and count."""
    numbers = [lengths, np.bincount(word, minlength=len(words)), np.bincount(doc, minlength=len(keys)), word, tf]
    columns = [listed(keys), pa.array([int(lengths.sum())], pa.int64()), pc.binary_join(listed(words), "\n")]
    return pa.RecordBatch.from_arrays([*columns, *map(packed, numbers)], names=["keys", "length", "words", *_NUMBERS])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, lo = np.concatenate(([0], np.cumsum(size))), 0
        while lo < batch.num_rows:
            hi = min(lo + DOCUMENTS, max(lo + 1, int(np.searchsorted(upto, upto[lo] + TEXT, "right")) - 1))
            some = batch.slice(lo, hi - lo)
            words, word, text = cut(some.column("text"))
            pair, tf = np.unique(text * max(len(words), 1) + word, return_counts=True)
            doc, word = np.divmod(pair, max(len(words), 1))
            yield _block(some.column("key"), words, np.bincount(text, minlength=hi - lo), doc, word, tf)
            lo = hi


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH`` bytes; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not (now and now.isdigit() and 0 < int(now) <= BATCH):
        spark.conf.set(name, BATCH)


def _even(rows: DataFrame) -> DataFrame:
    """Rows (key, text) in their tasks as they are read, if no task has far more than its share of them; else dealt by key."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = [n for _, n in rows.select("key").groupBy(F.spark_partition_id()).count().collect()]  # a row for each task
    return rows if max(sizes, default=0) * cores <= 1.5 * sum(sizes) else rows.repartition(max(cores, len(sizes)), "key")


def of(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Callable[..., DataFrame] = lambda df, *_: df) -> DataFrame:
    """Blocks of documents: keys and lengths, distinct words and in how many documents each is, and of each posting its word and count.

    Rows of one key count as one document: only such rows are brought together, all others are cut where they are read.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    again = keep(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("again")), "again")
    whole = _even(rows)
    if not again.isEmpty():
        same = F.col("key").eqNullSafe(F.col("again"))
        joined = rows.join(again, same, "left_semi").groupBy("key").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
        whole = whole.join(again, same, "left_anti").unionByName(joined)
    return blocked(whole)


def schema(key: T.DataType) -> T.StructType:
    fields = [("keys", T.ArrayType(key)), ("length", T.LongType()), ("words", T.StringType()), *((n, T.BinaryType()) for n in _NUMBERS)]
    return T.StructType([T.StructField(*f) for f in fields])


def blocked(rows: DataFrame) -> DataFrame:
    """Blocks of rows (key, text), each a document of its own that is cut where it is read."""
    bounded(rows.sparkSession)
    return rows.select("key", "text").mapInArrow(_blocked, schema(rows.schema["key"].dataType))


def words_of(column: pa.Array, k: int) -> pa.Array:
    """A block's words, none of which holds a line end."""
    one = column.slice(k, 1)
    return pc.split_pattern(one, "\n").flatten() if one[0].as_buffer() else one.slice(1)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    merge = lambda: pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"])
    for batch in batches:
        for k in range(batch.num_rows):
            words = words_of(batch.column("words"), k)
            held.append(pa.table({"term": words, "df": pa.array(unpacked(batch.column("found"), k, len(words)))}))
            size += len(words)
            if size > MERGED:
                held = [merge()]
                size = held[0].num_rows
                if size > MERGED // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                    held, size = [], 0
    if held:
        yield from merge().combine_chunks().to_batches(max_chunksize=1 << 16)


def frequencies(blocks: DataFrame) -> DataFrame:
    """``term, df``: in how many documents each word is."""
    some = blocks.select("words", "found").mapInArrow(_found, "term string, df long")
    return some.groupBy("term").agg(F.sum("df").alias("df"))


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            keys, words = batch.column("keys")[k].values, words_of(batch.column("words"), k)
            own, lengths = (unpacked(batch.column(c), k, len(keys)) for c in ("own", "lengths"))
            word, tf = (unpacked(batch.column(c), k, int(own.sum())) for c in ("word", "tf"))
            yield {"keys": keys, "words": words, "lengths": lengths, "doc": np.repeat(np.arange(len(keys)), own), "word": word, "tf": tf}


def gathered(postings: DataFrame) -> DataFrame:
    """Blocks of postings that are rows (term, key, tf, dl), none of them under the empty term."""
    each = postings.groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs"), F.first("dl").alias("dl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(lo, DOCUMENTS) for lo in range(0, batch.num_rows, DOCUMENTS)):
                found = some.column("terms").flatten().dictionary_encode()
                doc = np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column("terms")).to_numpy(zero_copy_only=False))
                whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
                yield _block(some.column("key"), found.dictionary, whole(some.column("dl")), doc, whole(found.indices), whole(some.column("tfs").flatten()))

    return each.mapInArrow(run, schema(postings.schema["key"].dataType))


def picked(blocks: DataFrame, column: str, keep: bool) -> DataFrame:
    """Blocks of only those of their documents whose places a block's ``column`` lists, or, without ``keep``, of all others; a
    block without a list is as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, places = batch.slice(k, 1), batch.column(column)[k]
                if not places.is_valid:
                    yield one.drop_columns([column])
                    continue
                b = next(read([one]))
                stay = np.full(len(b["keys"]), not keep)
                stay[places.values.to_numpy(zero_copy_only=False)] = keep
                if stay.any():
                    of = stay[b["doc"]]
                    used, word = np.unique(b["word"][of], return_inverse=True)
                    yield _block(b["keys"].filter(pa.array(stay)), b["words"].take(pa.array(used)), b["lengths"][stay], (np.cumsum(stay) - 1)[b["doc"][of]], word, b["tf"][of])

    kind = schema(blocks.schema["keys"].dataType.elementType)
    return blocks.select(*kind.names, column).mapInArrow(run, kind)


def postings(blocks: DataFrame, empty: bool = False) -> DataFrame:
    """``term, key, tf, dl``: a row for each term of each document; with ``empty`` one that has none is under the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read(batches):
            columns = [b["words"].take(pa.array(b["word"])), b["keys"].take(pa.array(b["doc"])), pa.array(b["tf"], pa.int64()), pa.array(b["lengths"][b["doc"]], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "tf", "dl"])
            none = np.flatnonzero(b["lengths"] == 0)
            if empty and len(none):
                n = len(none)
                columns = [pa.array([""] * n), b["keys"].take(pa.array(none)), pa.array(np.ones(n, np.int64)), pa.array(np.zeros(n, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "tf", "dl"])

    kind = blocks.schema["keys"].dataType.elementType
    fields = [("term", T.StringType()), ("key", kind), ("tf", T.LongType()), ("dl", T.IntegerType())]
    return blocks.drop("length", "found").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def best_cells(total: np.ndarray, floor: np.ndarray, place: np.ndarray, k: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the positive sums that ``slack`` below the column's ``floor`` does not rule out; of equal ones the ``k`` of smallest place."""
    row, col = np.nonzero(total >= np.maximum(floor - slack, 1))
    order = np.lexsort((place[row], -total[row, col], col))
    row, col = row[order], col[order]
    value = total[row, col]
    new = np.ones(len(row), bool)
    new[1:] = (col[1:] != col[:-1]) | (value[1:] != value[:-1])
    at = np.arange(len(row))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return row[keep], col[keep]


def rounded(total: np.ndarray, scale: float, digits: int) -> np.ndarray:
    """``total / scale`` as Spark's ``round`` has it: halves of the shortest decimal go up; only what lies near a half is looked at in decimals.

    Sums are not negative, and under 2 ** 53 when multiplied by 10 ** ``digits`` / ``scale``.
    """
    value, unit = total / scale, 10.0**digits
    high = value * unit
    whole = np.floor(high + 0.5)
    near = np.flatnonzero(np.abs(high - np.floor(high) - 0.5) <= high * 2.0**-50 + 2.0**-50)
    step = Decimal(1).scaleb(-digits)
    out = whole / unit
    out[near] = [float(Decimal(repr(x)).quantize(step, ROUND_HALF_UP)) for x in value[near].tolist()]
    return out


def sums(blocks: DataFrame, asked: list, query, avgdl: float, k1: float, b: float, scale: float, best: int | None, slack: int, digits: int) -> DataFrame:
    """``query_id, key, score`` of each document that holds a term of ``asked`` (query_id, term, idf), summed up in multiples of 1 / ``scale``.

    With ``best`` a task passes on only what may be among the best so many of a query.
    """
    bounded(blocks.sparkSession)
    terms = {t: n for n, t in enumerate(dict.fromkeys(r[1] for r in asked))}
    ids = list(dict.fromkeys(r[0] for r in asked))
    number = {q: n for n, q in enumerate(ids)}
    asked = sorted((terms[r[1]], number[r[0]], r[2]) for r in asked)
    who, weight = np.array([r[1] for r in asked], np.int64), np.zeros(max(len(terms), 1))
    weight[[r[0] for r in asked]] = [r[2] for r in asked]
    since = np.searchsorted(np.array([r[0] for r in asked], np.int64), np.arange(len(terms) + 1))
    kind = blocks.schema["keys"].dataType.elementType
    shown = to_arrow_type(query)
    held = blocks.sparkSession.sparkContext.broadcast((ids, list(terms), who, weight, since))  # at most ranking.ASKED terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, who, weight, since = held.value
        names, terms, n = pa.array(ids, shown), pa.array(terms, pa.string()), len(ids)
        top = np.zeros((best or 0, n), np.int64)
        for block in read(batches):
            term = pc.index_in(block["words"], value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[block["word"]]
            hit = np.flatnonzero(term >= 0)
            doc, term, f = block["doc"][hit], term[hit], block["tf"][hit].astype(np.float64)
            rel = block["lengths"][doc] / avgdl
            value = np.rint(weight[term] * f * (k1 + 1) / (f + k1 * (1 - b + b * rel)) * scale).astype(np.int64)
            each = since[term + 1] - since[term]
            step, size, lo = max(1, CELLS // max(n, 1)), len(block["keys"]), 0
            upto = np.searchsorted(doc, np.arange(size + 1))
            parts = np.concatenate(([0], np.cumsum(each)))[upto]
            while lo < size:
                hi = min(lo + step, max(lo + 1, int(np.searchsorted(parts, parts[lo] + CELLS, "right")) - 1), size)
                x, y, rows = upto[lo], upto[hi], hi - lo
                m = each[x:y]
                place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                cell = np.repeat(doc[x:y] - lo, m) * n + who[np.repeat(since[term[x:y]], m) + place]
                total, met = np.zeros(rows * n, np.int64), np.zeros(rows * n, bool)
                np.add.at(total, cell, np.repeat(value[x:y], m))
                total = total.reshape(rows, n)
                keys = block["keys"].slice(lo, rows)
                if best is None:
                    met[cell] = True
                    row, col = np.nonzero(met.reshape(rows, n))
                else:
                    both = np.concatenate((top, total))
                    top = np.partition(both, len(both) - best, axis=0)[-best:]
                    order = np.empty(rows, np.int64)
                    order[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(rows)
                    row, col = best_cells(total, top[0], order, best, slack)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(col)), keys.take(pa.array(row)), pa.array(rounded(total[row, col], scale, digits))], names=["query_id", "key", "score"])
                lo = hi

    return blocks.drop("length", "found").mapInArrow(run, T.StructType([T.StructField("query_id", query), T.StructField("key", kind), T.StructField("score", T.DoubleType())]))
