"""Near-duplicate paragraphs across documents: MinHash bands, exact verification, components.

Paragraphs are runs of sentences that end where the content says so (a hash of a
sentence's last words) or at a line's end, so a passage is cut alike wherever it stands.
Equal paragraphs are one vertex.  Bands propose families; the full five-word shingle sets of all
pairs of a family decide; of each component of linked paragraphs one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .collide import colliding
from .families import linked_within
from .minhash import _linked
from .scratch import Scratch, pieces_of, real_id, slim, tidy, tidy_group
from .textvec import U, Words, arrow_texts, blocks, minhashes, mix, seeds

#: Bands and minhashes of a band: a pair of similarity s meets with probability 1 - (1 - s**ROWS)**BANDS, 0.987 at 0.8.
BANDS, ROWS = 6, 3
WIDTH = 5
#: A sentence's end is a cut for one hash in CUT.
CUT = 2
SIMILAR = (80, 100)
#: Bytes of the rows that one Python task gathers, about.
TASK_BYTES = 8 << 20
#: Keys that hold at least one row in HOT each, of which there are at most HOT, are joined without a shuffle.
HOT = 1000


@dataclass(frozen=True)
class Lengths:
    """The least words of a compared paragraph, of a passage (neighbouring repeated paragraphs), and of a run of equal words.

    Of every ``take`` seeds of ``seed`` words one is taken, so a run of ``run`` equal words holds a taken seed, wherever it stands;
    taken seeds of a run are at most ``take`` words apart, so with ``take`` no larger than ``seed`` they leave no word between them.
    """

    least: int = 8
    passage: int = 24
    run: int = 24

    def __post_init__(self) -> None:
        if min(self.least, self.passage, self.run) < 1:
            raise ValueError("least, passage and run are 1 or more")

    @property
    def seed(self) -> int:
        return self.run // 2 + 1

    @property
    def take(self) -> int:
        return self.run - self.seed + 1


_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True


class Paragraphs:
    """The paragraphs of a block of texts: first and last word, text, and a hash of all words."""

    def __init__(self, texts: list[bytes], least: int):
        self.words = w = Words(texts)
        h, n = w.hashes(), len(w.start)
        self.hashes = h
        none = np.zeros(0, np.int64)
        if not n:
            self.first = self.last = self.text = none
            self.key = self.heads = none
            return
        newline = np.concatenate(([0], np.cumsum(w.raw == 10)))
        after = np.append(w.start[1:], len(w.raw))
        line_end = newline[after] - newline[w.end] > 0
        tail = mix(h + np.concatenate((h[:1], h[:-1])) * U(0x9E3779B97F4A7C15))
        cut = line_end | _ENDS[w.raw[w.end - 1]] & (tail % U(CUT) == 0)
        last_word = w.first[1:] - 1
        cut[last_word[last_word >= 0]] = True
        end = np.flatnonzero(cut) + 1
        first = np.concatenate(([0], end[:-1]))
        #: The first word of every paragraph, short ones too.
        self.heads = first
        text = np.searchsorted(w.first, first, "right") - 1
        self.number = np.arange(len(first)) - np.searchsorted(text, text)
        long = end - first >= least
        self.first, self.last, self.text, self.number = first[long], end[long], text[long], self.number[long]
        # A hash of a paragraph's words in their order.
        place = np.arange(n) - np.repeat(first, end - first)
        weight = seeds(int(place.max()) + 1, 909) | U(1)
        upto = np.concatenate((np.zeros(1, U), np.cumsum(h * weight[place])))
        self.key = mix(upto[self.last] - upto[self.first] + (self.last - self.first).astype(U)).view(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last byte of each paragraph within its text."""
        base = self.words.doc_start[self.text] if len(self.text) else self.text
        return self.words.start[self.first] - base, self.words.end[self.last - 1] - base

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """All paragraphs' shingle hashes, one paragraph after another, and how many each has: none of under ``WIDTH`` words."""
        h = self.hashes
        factor = seeds(WIDTH, 77) | U(1)
        n = max(0, len(h) - WIDTH + 1)
        s = np.zeros(n, U)
        for k in range(WIDTH):
            s += h[k : k + n] * factor[k]
        count = np.maximum(self.last - self.first - WIDTH + 1, 0)
        at = np.repeat(self.first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return mix(s)[at], count


def _rows(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in blocks(batch.column("id").to_pylist(), arrow_texts(batch)):
            p = Paragraphs(texts, least)
            if len(p.first):
                a, b = p.spans()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.key), pa.array(np.array(ids, np.int64)[p.text]), *[pa.array(x.astype(np.int32)) for x in (p.number, p.first - p.words.first[p.text], a, b, p.last - p.first)]],
                    names=["key", "id", "number", "place", "begin", "finish", "n_words"],
                )


def _bands(least: int, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    seen: set[int] = set()
    for _, texts in blocks(batch.column("id").to_pylist(), arrow_texts(batch)):
        p = Paragraphs(texts, least)
        if not len(p.first):
            continue
        flat, count = p.shingles()
        key, one = np.unique(p.key, return_index=True)
        # Paragraphs without a shingle are compared by their words only.
        new = np.fromiter((k not in seen for k in key.tolist()), bool, len(key)) & (count[one] > 0)
        one = one[new]
        seen.update(key[new].tolist())
        if len(one):
            n = count[one]
            at = np.repeat((np.cumsum(count) - count)[one] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            sig = minhashes(flat[at], np.cumsum(n) - n, BANDS * ROWS, 31).reshape(len(one), BANDS, ROWS)
            for b in range(BANDS):
                h = np.full(len(one), b + 1, U)
                for r in range(ROWS):
                    h = mix(h * U(0x100000001B3) + sig[:, b, r])
                yield h, p.key[one]


def _shingle_sets(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of wanted paragraphs: rows (text, wanted [(number, key)])."""
    for batch in batches:
        keys, sets = [], []
        wanted = batch.column("wanted").to_pylist()
        for numbers, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
            p = Paragraphs(texts, least)
            flat, count = p.shingles()
            begin = np.cumsum(count) - count
            index = {(t, n): k for k, (t, n) in enumerate(zip(p.text.tolist(), p.number.tolist(), strict=True))} if len(p.first) else {}
            for t, number in enumerate(numbers):
                for x in wanted[number]:
                    k = index.get((t, x["number"]))
                    if k is not None and int(p.key[k]) == x["key"]:
                        keys.append(x["key"])
                        sets.append(np.unique(flat[begin[k] : begin[k] + count[k]]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "shingles"])


def _similar(data: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _linked([np.frombuffer(x, U) for x in data], left, right, *SIMILAR)


def _runs_of(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each word on."""
    n = max(0, len(h) - size + 1)
    factor, s = seeds(size, 55) | U(1), np.zeros(n, U)
    for k in range(size):
        s += h[k : k + n] * factor[k]
    return mix(s)


def _seeds(lengths: Lengths, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every ``take`` seeds in a row the least: rows (key, id, place), the place in words."""
    take = lengths.take
    for batch in batches:
        for ids, texts in blocks(batch.column("id").to_pylist(), arrow_texts(batch)):
            w = Words(texts)
            s = _runs_of(w.hashes(), lengths.seed)
            if len(s) < take:
                continue
            at = np.arange(len(s) - take + 1)
            text = np.searchsorted(w.first, at, "right") - 1
            whole = at + lengths.run <= w.first[text + 1]
            at = np.unique((at + np.lib.stride_tricks.sliding_window_view(s, take).argmin(axis=1))[whole])
            text = np.searchsorted(w.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(s[at].view(np.int64)), pa.array(np.array(ids, np.int64)[text]), pa.array((at - w.first[text]).astype(np.int32))], names=["key", "id", "place"])


_AROUND = "id long, seeds binary, key long, before binary, after binary, members binary"
#: A met seed: the least id that holds it, the paragraph it begins in, its first word, first and past-the-last byte.
_MET = (("key", np.int64), ("one", np.int64), ("number", np.int32), ("place", np.int32), ("begin", np.int32), ("finish", np.int32))
_MEMBER = np.dtype([("id", np.int64), ("place", np.int32), ("begin", np.int32), ("finish", np.int32)])
#: A word beside a seed: 32 bits of its hash, and how far its other end is from the seed in bytes.
_BESIDE = np.dtype([("word", np.uint32), ("far", np.int32)])
#: Surroundings that a task gathers before it passes them on.
GATHER = 100_000


def _packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(x.astype(kind).tobytes() for x, (_, kind) in zip(columns, _MET, strict=True))


def _unpacked(data: bytes) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(kind).itemsize for _, kind in _MET), 0, []
    for _, kind in _MET:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _around(lengths: Lengths, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a text's met seeds lie in bytes, all in one row; and of those at a run's end the words before (nearest first)
    and after, as far as a run can go without another seed, once for all members with the same ones."""
    fields, kinds = [c.split() for c in _AROUND.split(", ")], {"long": pa.int64(), "binary": pa.binary()}
    beside: dict[tuple, list] = {}
    seed, take = lengths.seed, lengths.take

    def rows(got: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*got, strict=True)) if got else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    def held() -> pa.RecordBatch:
        out = rows([(None, None, key, x, y, np.array(m, _MEMBER).tobytes()) for (key, x, y), m in beside.items()])
        beside.clear()
        return out

    for batch in batches:
        got, all_ids = [], batch.column("id").to_pylist()
        lists = batch.column("wanted")
        cut, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        place, key, one, edge = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "key", "one", "edge"))
        for numbers, texts in blocks(list(range(batch.num_rows)), arrow_texts(batch)):
            p = Paragraphs(texts, lengths.least)
            w, h = p.words, p.hashes
            s = _runs_of(h, seed).view(np.int64)
            if not len(s):
                continue
            short, lo = h.astype(np.uint32), cut[numbers[0]]
            mine = slice(lo, cut[numbers[-1] + 1])
            text = np.repeat(np.arange(len(texts)), np.diff(cut[numbers[0] : numbers[-1] + 2]))
            k = w.first[text] + place[mine]
            # Others are seeds of another row of the same id.
            own = np.flatnonzero((k + seed <= w.first[text + 1]) & (s[np.minimum(k, len(s) - 1)] == key[mine]))
            _, once = np.unique(k[own], return_index=True)
            own = own[once]
            k, text = k[own], text[own]
            its_key, its_one, its_edge, its_place = key[mine][own], one[mine][own], edge[mine][own], place[mine][own]
            begin, finish, base = w.start[k], w.end[k + seed - 1], w.doc_start[text]
            nth = np.searchsorted(p.heads, k, "right") - np.searchsorted(p.heads, w.first[text]) - 1
            columns = [its_key, its_one, nth, its_place, begin - base, finish - base]
            part = np.flatnonzero(np.diff(text, prepend=-1, append=len(texts)))
            for a, b in pairwise(part.tolist()):
                got.append((all_ids[numbers[text[a]]], _packed([x[a:b] for x in columns]), None, None, None, None))
            for j in np.flatnonzero(its_edge).tolist():
                at, t = int(k[j]), int(text[j])
                lo, hi = max(int(w.first[t]), at - take), min(int(w.first[t + 1]), at + seed + take)
                sides = np.empty(at - lo, _BESIDE), np.empty(hi - at - seed, _BESIDE)
                sides[0]["word"], sides[0]["far"] = short[lo:at][::-1], begin[j] - w.start[lo:at][::-1]
                sides[1]["word"], sides[1]["far"] = short[at + seed : hi], w.end[at + seed : hi] - finish[j]
                beside.setdefault((int(its_key[j]), *(y.tobytes() for y in sides)), []).append((all_ids[numbers[t]], int(its_place[j]), int(begin[j] - base[j]), int(finish[j] - base[j])))
        yield rows(got)
        if len(beside) >= GATHER:
            yield held()
    if beside:
        yield held()


def _common(s: np.ndarray, t: np.ndarray) -> int:
    n = min(len(s), len(t))
    same = s["word"][:n] == t["word"][:n]
    return n if same.all() else int(same.argmin())


def _extended(lengths: Lengths, table: pa.Table) -> pa.Table:
    """How far each seed at a run's end can be extended by words that follow one of the same key in another document too.

    In order of the words around them, the nearest row of another document on either side has most in common.
    """
    key = table.column("key").to_numpy()
    members = [np.frombuffer(x, _MEMBER) for x in table.column("members").to_pylist()]
    own = [(m["id"].min(), m["id"].max()) for m in members]
    reach = []
    for side in ("before", "after"):
        text = [np.frombuffer(x, _BESIDE) for x in table.column(side).to_pylist()]
        # Members of several documents with the same words have all of them in common.
        best = [len(x) if low != high else 0 for x, (low, high) in zip(text, own, strict=True)]
        plain = [x["word"].astype(">u4").tobytes() for x in text]
        order = sorted(range(len(key)), key=lambda k: (key[k], plain[k]))
        for way in (order, order[::-1]):
            near: list[int] = []  # the row before, and the nearest one of another document than that row's
            for k in way:
                if near and key[near[0]] != key[k]:
                    near = []
                for j in near:
                    if own[j] != own[k] or own[k][0] != own[k][1]:
                        best[k] = max(best[k], _common(text[k], text[j]))
                        break
                near = [k, *[j for j in near if own[j] != own[k] or own[k][0] != own[k][1]][:1]]
        n = [len(m) for m in members]
        reach.append((np.repeat(np.array(best, np.int32), n), np.repeat(np.array([x["far"][b - 1] if b else 0 for b, x in zip(best, text, strict=True)], np.int32), n)))
    flat = np.concatenate(members)
    (left, back), (right, on) = reach
    return pa.table({"id": flat["id"], "place": flat["place"] - left, "n_words": lengths.seed + left + right, "begin": flat["begin"] - back, "finish": flat["finish"] + on})


_PIECE = "id long, number int, begin int, finish int, n_words int, component long, one long"


def _pieces(lengths: Lengths, table: pa.Table) -> pa.Table:
    """What common runs of at least ``run`` words hold beside the rows there are, of many documents.

    ``kind`` 0: the met seeds of a text; 1: one with the words it is extended by; 2: rows, whose words are taken.
    A row may come more than once.
    """
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [c.split() for c in _PIECE.split(", ")]
    ids, kind, place, size, begin, finish = (table.column(c).to_numpy() for c in ("id", "kind", "place", "n_words", "begin", "finish"))
    texts, rest = np.flatnonzero(kind == 0), np.flatnonzero(kind != 0)
    seen = [_unpacked(x) for x in table.column("seeds").take(texts).to_pylist()]
    key, one, number, *where = (np.concatenate([np.zeros(len(rest), kind_of), *[x[c] for x in seen]]) for c, (_, kind_of) in enumerate(_MET))
    n_seen = [len(x[0]) for x in seen]
    ids, kind = (np.concatenate((x[rest], np.repeat(x[texts], n_seen))) for x in (ids, kind))
    size = np.concatenate((size[rest], np.full(sum(n_seen), lengths.seed, np.int32)))
    place, begin, finish = (np.concatenate((x[rest], y[len(rest) :])) for x, y in zip((place, begin, finish), where, strict=True))
    del seen, where
    order = np.lexsort((place, kind, ids))
    cut = np.append(np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])), len(order)) if len(order) else [0]
    out = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        mine = order[lo:hi]
        seeds, far, rows = (mine[kind[mine] == k] for k in (0, 1, 2))
        if not len(seeds):
            continue
        word = np.arange(int((place[mine] + size[mine]).max()) + 1)
        # A word is of the last seed that holds it, or whose extension does: one extended counts as the first seed in it.
        last = np.searchsorted(place[seeds], word, "right") - 1
        last[word >= place[seeds][last] + lengths.seed] = -1
        first_seed = np.searchsorted(place[seeds], place[far], "left").clip(max=len(seeds) - 1)
        for k, j in zip(far.tolist(), first_seed.tolist(), strict=True):
            span = last[place[k] : place[k] + size[k]]
            np.maximum(span, j, out=span)
        of = np.where(last >= 0, seeds[last], -1)
        starts, stops = np.full(len(word), -1), np.full(len(word), -1)
        for k in (seeds, far):
            starts[place[k]], stops[place[k] + size[k]] = begin[k], finish[k]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], of >= 0)).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a < lengths.run:
                of[a:b] = -1
        for k in rows.tolist():
            a, b = int(place[k]), int(place[k] + size[k])
            of[a:b] = -1
            starts[b] = finish[k] if starts[b] < 0 else starts[b]
            stops[a] = begin[k] if stops[a] < 0 else stops[a]
        who = np.where(of >= 0, one[of], 0)
        new = np.flatnonzero(np.diff(of < 0, prepend=True) | np.diff(who, prepend=0).astype(bool))
        for a, b in pairwise([*new.tolist(), len(of)] if len(new) else []):
            if of[a] >= 0:
                begins, ends = (starts[a] if starts[a] >= 0 else stops[a]), (stops[b] if stops[b] >= 0 else starts[b])
                out.append((ids[mine[0]], number[of[a]], begins, ends, b - a, key[of[a]], who[a]))
    columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _joined(rows: DataFrame, keys: DataFrame, held: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keys`` by ``key``; rows of the keys in ``held``, at most ``HOT`` of them, stay where they are."""
    few = held.join(keys.join(F.broadcast(held), "key", "left_semi"), "key", "left")
    marked = rows.join(F.broadcast(few.withColumn("held", F.lit(True))), "key", "left")
    hot = marked.where("held").drop("held")
    return hot.unionByName(marked.where("held is null").select(*rows.columns).join(keys, "key", how))


def _common_runs(texts: DataFrame, rows: DataFrame, scratch: Scratch, lengths: Lengths) -> DataFrame:
    """Pieces of runs of at least ``run`` words that stand word for word in another document too, outside of ``rows``."""
    spark, take = scratch.spark, lengths.take
    taken = scratch.keep(texts.mapInArrow(tidy(partial(_seeds, lengths)), "key long, id long, place int"), "taken")
    shared = taken.groupBy("key").agg(F.min("id").alias("one"), F.max("id").alias("high"), F.count("*").alias("n")).where("one <> high")
    shared = scratch.keep(shared.select("key", "one", "n"), "shared")
    held = scratch.keep(shared.where(F.col("n") * HOT >= max(1, taken.count())).select("key"), "held")
    met = scratch.keep(_joined(taken, shared.drop("n"), held), "met")
    scratch.drop("taken")
    # Seeds of a run are at most ``take`` words apart; only where none follows can a run go on unseen.
    ends = met.selectExpr("key", "place", "lag(place) over (partition by id order by place) as low", "lead(place) over (partition by id order by place) as top")
    ends = scratch.keep(ends.where(f"low is null or top is null or place - low > {take} or top - place > {take}").select("key").distinct().withColumn("edge", F.lit(True)), "ends")
    edged = _joined(met, ends, held, "left")
    wanted = edged.groupBy("id").agg(F.collect_list(F.struct("place", "key", "one", F.coalesce("edge", F.lit(False)).alias("edge"))).alias("wanted"))
    around = scratch.keep(texts.join(wanted, "id").mapInArrow(tidy(partial(_around, lengths)), _AROUND), "around")
    for name in ("met", "shared", "held", "ends"):
        scratch.drop(name)
    sizes = around.agg(*[F.coalesce(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in names)), F.lit(0)) for names in (("before", "after", "members"), ("seeds", "members"))]).first()
    task = F.pmod(F.xxhash64("key"), F.lit(pieces_of(spark, sizes[0], TASK_BYTES)))
    far = around.where("members is not null").withColumn("task", task).groupBy("task").applyInArrow(tidy_group(partial(_extended, lengths)), "id long, place int, n_words int, begin int, finish int")
    shape, zero, none = ["id", "place", "n_words", "begin", "finish"], F.lit(0), F.lit(None).cast("binary").alias("seeds")
    seeds = around.where("seeds is not null").select(zero.alias("kind"), "id", *[zero.alias(c) for c in shape[1:]], "seeds")
    every = seeds.union(far.select(F.lit(1), *shape, none)).union(rows.select(F.lit(2), *shape, none))
    task = F.pmod(F.xxhash64("id"), F.lit(pieces_of(spark, sizes[1] + 28 * rows.count(), TASK_BYTES)))
    return every.withColumn("task", task).groupBy("task").applyInArrow(tidy_group(partial(_pieces, lengths)), _PIECE)


def repeated_paragraphs(docs: DataFrame, least: int = 8, passage: int = 24, run: int = 24) -> DataFrame:
    """A row for each paragraph that another document's resembles: ``doc_id, paragraph, begin, finish, n_words, component_id, kept_doc_id, removed``.

    ``begin`` and ``finish`` are bytes of the UTF-8 text.  Linked are paragraphs of at least ``least``
    words with equal words, or with at least 0.8 exact Jaccard similarity of their five-word shingles (those of under five words have none);
    components whose paragraphs are all in one document are left out, and so are
    passages (neighbouring such paragraphs of a document) of under ``passage`` words, which
    are taken for stock lines: with ``least`` and ``passage`` 1 every repeated paragraph counts, however short.  Of a component the
    paragraph of the smallest (doc_id, paragraph) stays: ``removed`` is false there, and ``kept_doc_id`` names its document.
    ``component_id`` is the least hash of its paragraphs.  What runs of at least ``run`` words that stand
    word for word in two documents hold beside these, wherever they begin and end, makes rows of its own:
    the smallest document stays, ``paragraph`` is the one that its first seed begins in, ``component_id`` a hash of its words.  Null and empty texts have no paragraphs, a null
    id is the smallest, repeated rows of one id count as one document.
    """
    spark, lengths = docs.sparkSession, Lengths(least, passage, run)
    scratch = Scratch(spark, "paragraphs", free=True)
    slimmed = slim(docs)
    rows = scratch.keep(slimmed.mapInArrow(partial(_rows, least), "key long, id long, number int, place int, begin int, finish int, n_words int"), "rows")
    pairs = scratch.keep(colliding(slimmed, partial(_bands, least), pieces_of(spark, rows.count() * BANDS * 16)), "pairs")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()

    classes = rows.groupBy("key").agg(F.min(F.struct("id", "number")).alias("one"), F.max("id").alias("high"))
    # One paragraph speaks for each key of a proposed pair: its shingles are taken from its text.
    spoken = ends.join(classes, "key").select("one.id", F.struct("one.number", "key").alias("w")).groupBy("id").agg(F.collect_list("w").alias("wanted"))
    sets = slimmed.join(spoken, "id").select("text", "wanted").mapInArrow(partial(_shingle_sets, least), "key long, shingles binary").dropDuplicates(["key"])
    sets = scratch.keep(sets, "sets")
    # A band's rows meet their leader only, so whatever meets is one family, and all pairs of a family are decided.
    family = graph.components(pairs, scratch, "family")
    links = linked_within(family, sets.select(F.col("key").alias("id"), F.col("shingles").alias("data")), _similar, scratch, "pairs-of")
    found = graph.components(links, scratch, "linked", contracted=True)
    scratch.drop("pairs")
    scratch.drop("sets")

    linked = found.union(found.select(F.col("component").alias("id"), "component").distinct()).select(F.col("id").alias("key"), "component")
    # Keys of one document only that are linked with no other cannot be in a row of the result.
    open_keys = classes.join(linked, "key", "left").where("component is not null or one.id <> high")
    open_keys = open_keys.withColumn("component", F.coalesce("component", "key"))
    whole = open_keys.groupBy("component").agg(F.min("one").alias("kept"), F.max("high").alias("most")).where("kept.id <> most")
    keys = scratch.keep(open_keys.select("key", "component").join(whole.select("component", "kept"), "component"), "keys")
    out = rows.join(keys, "key")
    # Neighbours make one passage, also across one paragraph too short to be compared.
    out = out.withColumn("first", F.expr("number - lag(number, 1, -9) over (partition by id order by number) > 2"))
    out = out.withColumn("run", F.expr("sum(int(first)) over (partition by id order by number)"))
    out = out.withColumn("passage", F.expr("sum(n_words) over (partition by id, run)")).where(F.col("passage") >= passage)
    out = out.select("id", "number", "place", "begin", "finish", "n_words", "component", F.col("kept.id").alias("one"), (F.struct("id", "number") != F.col("kept")).alias("removed"))
    out = scratch.keep(out, "out")
    scratch.drop("rows")
    scratch.drop("keys")
    more = _common_runs(slimmed, out, scratch, lengths)
    out = out.drop("place").unionByName(more.withColumn("removed", F.col("id") != F.col("one")))
    return out.select(
        real_id().alias("doc_id"),
        F.col("number").alias("paragraph"),
        "begin",
        "finish",
        "n_words",
        F.col("component").alias("component_id"),
        real_id("one").alias("kept_doc_id"),
        "removed",
    )
