"""Exact substring dedup: maximal repeats from a distributed enhanced suffix array.

Texts are cut into content-defined chunks of 50-byte string starts.  A chunk
whose bytes also occur in an earlier document is settled by its hash alone.
What is left is cut into segments whose string starts share one minimiser and the same side of it, so
equal strings always meet in one bucket: the key of a segment is its minimiser with the bytes on that side, about two thirds of a string,
as short grams alone soon all occur twice where words repeat.  Only segments whose key occurs
in other content travel, and those of a key that many parts report go string by string, so that
no key makes a bucket that grows with the corpus.  A bucket sorts the suffixes of its segments, computes
the common prefixes of neighbours and scans them with a stack: every interval
of suffixes with a common prefix of at least ``length`` bytes that cannot be
extended to the left by one common byte is a maximal repeat, and is put out
with all its occurrences and the smallest document that holds it.

Documents are dealt to parts by a hash of their id; the number of parts and
buckets follows the bytes of the texts, not the session's settings.  A task sees a whole part
and passes on each chunk, key or segment once, so content that a third of
all documents share reaches its bucket once for each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, parts_by_size, real_id, slim
from .textvec import U, arrow_texts, blocks, mix

#: Bytes of a minimiser's gram.
GRAM = 16
#: String starts of a segment at most, and segments of a chunk.
RUN, CHUNK = 35, 128
#: A chunk ends with a segment whose key is divisible by this.
CUT = 32
#: Suffixes that are sorted together.
SORT = 150_000
#: Text bytes of a part, which one task holds at a time.
PART_BYTES = 8 << 20
#: Parts that report one key from which its segments no longer go to one bucket: each of their string starts goes by its own hash.
HOT = 64
CHUNKS, GRAMS, SPANS, HOTS = 0, 1, 2, 3
_CHUNK = np.dtype([("c1", U), ("c2", U), ("doc", np.int64)])
#: 40 bits of a key, and 56 of the chunk it occurs in, on their way in 12 bytes: the same 40 bits of two keys only send more segments.
_GRAM, _SENT = np.dtype([("m", U), ("tag", U)]), np.dtype("V12")
_LOW, _REST, _OCTET, _WORD = U(24), U(8), U(255), U((1 << 32) - 1)
_RECORD = np.dtype([("m", U), ("rid", np.int32), ("size", np.int32), ("low", np.int64), ("high", np.int64)])
_SPAN = np.dtype([("rid", np.int32), ("at", np.int32), ("size", np.int32), ("doc", np.int64)])


class _Part:
    """Chunks and segments of one part's documents, in a defined order."""

    def __init__(self, table: pa.Table, length: int):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = table.column("id").to_numpy()
        self.texts = arrow_texts(table)
        self.length = length
        starts, sizes, grams, doc, last = [], [], [], [], []
        self.base = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        joined = b"".join(self.texts)
        self.data, self.view = np.frombuffer(joined, np.uint8), memoryview(joined)
        k = 0
        for numbers, some in blocks(list(range(len(self.texts))), self.texts):
            s, n, m, d = self._segments(self.base[numbers[0]], self.base[numbers[-1] + 1], numbers)
            starts.append(s)
            sizes.append(n)
            grams.append(m)
            doc.append(d)
            k += len(some)
        none = np.zeros(0, np.int64)
        self.start, self.size, self.doc = (np.concatenate([none, *x]).astype(np.int64) for x in (starts, sizes, doc))
        self.gram = np.concatenate([np.zeros(0, U), *grams])
        n = len(self.start)
        new = np.ones(n + 1, bool)
        new[1:n] = (self.doc[1:] != self.doc[:-1]) | (self.gram[:-1] % U(CUT) == 0)
        at = np.flatnonzero(new)
        extra = [np.arange(a + CHUNK, b, CHUNK) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > CHUNK]
        self.chunk_first = np.sort(np.concatenate([at[:-1], *extra])).astype(np.int64) if n else at[:0]
        ends = np.concatenate((self.chunk_first[1:], [n])).astype(np.int64)
        self.chunk_of = np.repeat(np.arange(len(self.chunk_first)), ends - self.chunk_first)
        self.chunk_start = self.start[self.chunk_first]
        self.chunk_end = self.start[ends - 1] + self.size[ends - 1] + length - 1 if n else at[:0]
        self.chunk_doc = self.ids[self.doc[self.chunk_first]]
        view = self.view
        digest = hashlib.blake2b
        self.chunk_hash = np.frombuffer(b"".join(digest(view[a:b], digest_size=16).digest() for a, b in zip(self.chunk_start.tolist(), self.chunk_end.tolist(), strict=True)), np.dtype([("c1", U), ("c2", U)]))

    def _segments(self, lo: int, hi: int, numbers: list[int]):
        length, width = self.length, self.length - GRAM + 1
        none = np.zeros(0, np.int64)
        n = hi - lo - length + 1
        if n <= 0:
            return none, none, np.zeros(0, U), none
        text = self.data[lo:hi]
        padded = np.concatenate((text, np.zeros(16, np.uint8)))
        word = np.empty(len(text) + 8, U)
        for o in range(8):
            piece = padded[o : o + (len(padded) - o) // 8 * 8].view(U)
            into = word[o::8]
            into[: len(piece)] = piece[: len(into)]
        g = len(text) - GRAM + 1
        hashes = mix(word[:g] * U(0x9E3779B97F4A7C15) + word[8 : g + 8] * U(0xC2B2AE3D27D4EB4F))
        # The least 32 bits, the first of equal ones, with their place.
        h = hashes & ~_WORD | np.arange(g, dtype=U)
        reach = 1
        while reach < width:  # minima of windows of twice the width, up to the width asked for
            step = min(reach, width - reach)
            h = np.minimum(h[: len(h) - step], h[step:])
            reach += step
        first, last = self.base[numbers[0] : numbers[-1] + 1] - lo, self.base[numbers[0] + 1 : numbers[-1] + 2] - lo - length + 1
        there = last > first
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, first[there], 1)
        np.add.at(edge, last[there], -1)
        valid = np.cumsum(edge[:-1]) > 0
        new = np.zeros(n + 1, bool)
        place = (h & _WORD).astype(np.int64)
        # A string that holds a minimiser holds as much again of what is before it, or of what is after it.
        side = min((length - GRAM) // 2, GRAM)
        before = place - np.arange(n) >= side
        new[1:n] = (place[1:] != place[:-1]) | (before[1:] != before[:-1])
        new[first[there]] = True
        new[last[there]] = True
        new[n] = True
        at = np.flatnonzero(new)
        start, stop = at[:-1], at[1:]
        keep = valid[start]
        start, stop = start[keep], stop[keep]
        before = before[start]
        at = place[start] - side * before
        key = mix(hashes[at] * U(0x9E3779B97F4A7C15) + hashes[at + side] * U(0xC2B2AE3D27D4EB4F) + before.astype(U))
        pieces = -(-(stop - start) // RUN)
        if (pieces > 1).any():
            which = np.repeat(np.arange(len(start)), pieces)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = start[which] + nth * RUN
            stop, start, key = np.minimum(begin + RUN, stop[which]), begin, key[which]
        doc = np.searchsorted(self.base, start + lo, "right") - 1
        return start + lo, stop - start, key, doc

    def chunk_entries(self) -> np.ndarray:
        """Each chunk hash of the part with its smallest document."""
        out = np.empty(len(self.chunk_hash), _CHUNK)
        out["c1"], out["c2"], out["doc"] = self.chunk_hash["c1"], self.chunk_hash["c2"], self.chunk_doc
        return _first_of(out, ("c1", "c2"), "doc")

    def gram_entries(self) -> np.ndarray:
        """Each key with the least and greatest tag of the chunks it occurs in: two tags are two contents."""
        x = np.empty(len(self.gram), _GRAM)
        x["m"] = self.gram >> _LOW
        x["tag"] = (self.chunk_hash["c1"] >> _REST)[self.chunk_of]
        return _ends(x)[0]

    def settled(self, back: np.ndarray) -> np.ndarray:
        """Chunks that an earlier document holds, given the smaller documents that other parts report."""
        own = self.chunk_entries()
        best = _first_of(np.concatenate((own, back)), ("c1", "c2"), "doc")
        order = np.lexsort((self.chunk_hash["c2"], self.chunk_hash["c1"]))
        mine = self.chunk_hash[order]
        change = np.ones(len(mine), bool)
        change[1:] = (mine["c1"][1:] != mine["c1"][:-1]) | (mine["c2"][1:] != mine["c2"][:-1])
        low = np.empty(len(mine), np.int64)
        low[order] = best["doc"][np.cumsum(change) - 1]
        return self.chunk_doc > low

    def open_segments(self, settled: np.ndarray, shared: np.ndarray, hot: np.ndarray) -> _Open:
        """The segments left to decide; those of a hot key start by start, each with the hash of its own string."""
        m = self.gram >> _LOW
        wanted = np.isin(m, shared) & ~settled[self.chunk_of]
        many = wanted & np.isin(m, hot)
        seg, each = np.flatnonzero(wanted & ~many), np.flatnonzero(many)
        n = self.size[each]
        which = np.repeat(each, n)
        start = np.concatenate((self.start[seg], self.start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)))
        size = np.concatenate((self.size[seg], np.ones(len(which), np.int64)))
        known: dict[bytes, int] = {}
        view = self.view
        rid = np.fromiter((known.setdefault(bytes(view[x:y]), len(known)) for x, y in zip(start.tolist(), (start + size + self.length - 1).tolist(), strict=True)), np.int64, len(start))
        texts = list(known)
        m = np.zeros(len(texts), U)
        m[rid[: len(seg)]] = self.gram[seg]
        for k in np.unique(rid[len(seg) :]).tolist():
            m[k] = int.from_bytes(hashlib.blake2b(texts[k], digest_size=8).digest(), "little")
        return _Open(start, size, np.concatenate((self.doc[seg], self.doc[which])), texts, rid, m)


class _Open(NamedTuple):
    """Segments by first byte, string starts and document, each one's distinct text, and what the texts are dealt by."""

    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    texts: list[bytes]
    rid: np.ndarray
    m: np.ndarray


def _ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries of each key the least and, if it differs, the greatest; how many there were of each; and which have two."""
    x = x[np.lexsort((x["tag"], x["m"]))]
    head = np.ones(len(x), bool)
    head[1:] = x["m"][1:] != x["m"][:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(x))[: len(first)] - 1
    two = x[first] != x[last]
    return np.concatenate((x[first], x[last[two]])), last - first + 1, two


def _packed(x: np.ndarray) -> bytes:
    out = np.empty((len(x), 3), "<u4")
    out[:, 0], out[:, 1], out[:, 2] = x["m"] >> _REST, (x["m"] & _OCTET) << _LOW | x["tag"] >> U(32), x["tag"] & _WORD
    return out.tobytes()


def _unpacked(sent: np.ndarray) -> np.ndarray:
    w = np.frombuffer(sent.tobytes(), "<u4").reshape(-1, 3).astype(U)
    x = np.empty(len(w), _GRAM)
    x["m"], x["tag"] = w[:, 0] << _REST | w[:, 1] >> _LOW, (w[:, 1] & U((1 << 24) - 1)) << U(32) | w[:, 2]
    return x


def _first_of(x: np.ndarray, keys: tuple[str, ...], value: str) -> np.ndarray:
    x = x[np.lexsort((x[value], *(x[k] for k in reversed(keys))))]
    head = np.ones(len(x), bool)
    head[1:] = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in keys])
    return x[head]


def _deal(by: np.ndarray, x: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    bucket = (by % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate((np.ones(min(len(bucket), 1), bool), bucket[1:] != bucket[:-1], np.ones(min(len(bucket), 1), bool))))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[a]), order[a:b], x[order[a:b]]


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    kinds = [pa.binary() if n == "data" else pa.int32() for n in names]
    return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})


def _emit(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        part = _Part(table, length)
        me = table.column("part")[0].as_py()
        chunks, grams = part.chunk_entries(), part.gram_entries()
        rows = [(b, me, CHUNKS, x.tobytes()) for b, _, x in _deal(mix(chunks["c1"]), chunks, buckets)]
        rows += [(b, me, GRAMS, _packed(x)) for b, _, x in _deal(mix(grams["m"]), grams, buckets)]
        return _rows(rows, ("bucket", "part", "kind", "data"))

    return run


def _gathered(table: pa.Table, kind: int, dtype: np.dtype, owner: str = "part") -> tuple[np.ndarray, np.ndarray]:
    """The entries of one kind, and whose each is."""
    own, kinds, data = table.column(owner).to_numpy(), table.column("kind").to_numpy(), table.column("data").to_pylist()
    some = [k for k in range(len(own)) if kinds[k] == kind]
    x = np.frombuffer(b"".join(data[k] for k in some), dtype)
    return x, np.repeat(own[some], [len(data[k]) // dtype.itemsize for k in some]) if some else own[:0]


def _compare(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For a bucket: to each part the chunks that a smaller document of another part holds, and its shared keys."""
        rows = []
        x, own = _gathered(table, CHUNKS, _CHUNK)
        order = np.lexsort((x["doc"], x["c2"], x["c1"]))
        x, own = x[order], own[order]
        head = np.ones(len(x), bool)
        head[1:] = (x["c1"][1:] != x["c1"][:-1]) | (x["c2"][1:] != x["c2"][:-1])
        low = x["doc"][head][np.cumsum(head) - 1] if len(x) else x["doc"]
        later = x["doc"] > low
        back = x[later]
        back["doc"] = low[later]
        rows += [(p, CHUNKS, y.tobytes()) for p, _, y in _deal(own[later].astype(U), back, 1 << 31)]
        x, own = _gathered(table, GRAMS, _SENT)
        x = _unpacked(x)
        order = np.argsort(x["m"], kind="stable")
        x, own = x[order], own[order]
        if len(x):
            _, n, differs = _ends(x)
            for kind, some in ((GRAMS, np.repeat(differs, n)), (HOTS, np.repeat(differs & (n > hot), n))):
                rows += [(p, kind, y.tobytes()) for p, _, y in _deal(own[some].astype(U), x["m"][some], 1 << 31)]
        return _rows(rows, ("part", "kind", "data"))

    return run


def _answers(table: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(_gathered(table, k, d)[0] for k, d in ((CHUNKS, _CHUNK), (GRAMS, np.dtype(U)), (HOTS, np.dtype(U)), (SPANS, _SPAN)))


def _records(length: int, buckets: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        names = ("bucket", "part", "kind", "data")
        if not docs.num_rows:
            return _rows([], names)
        part = _Part(docs, length)
        chunks, shared, hot, _ = _answers(back)
        seg = part.open_segments(part.settled(chunks), shared, hot)
        texts = seg.texts
        if not texts:
            return _rows([], names)
        me = docs.column("part")[0].as_py()
        rec = np.zeros(len(texts), _RECORD)
        doc = part.ids[seg.doc]
        rec["m"], rec["rid"], rec["size"] = seg.m, np.arange(len(texts)), [len(t) for t in texts]
        rec["low"], rec["high"] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        np.minimum.at(rec["low"], seg.rid, doc)
        np.maximum.at(rec["high"], seg.rid, doc)
        rows = []
        for b, which, x in _deal(mix(rec["m"]), rec, buckets):
            rows.append((b, me, 0, x.tobytes()))
            rows.append((b, me, 1, b"".join(texts[k] for k in which.tolist())))
        return _rows(rows, names)

    return run


def maximal_repeats(rec: np.ndarray, text: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Occurrences (record, offset, bytes, smallest document) of the maximal repeats among records.

    ``text`` is the records' bytes, one after another.  A suffix at a record's
    start counts as one that no common byte extends.  Only repeats over more
    than one document are put out.
    """
    begin = np.cumsum(rec["size"]) - rec["size"]
    count = np.maximum(rec["size"] - length + 1, 0).astype(np.int64)
    owner = np.repeat(np.arange(len(rec)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[owner] + offset
    # Only suffixes whose first ``length`` bytes occur twice can be in a repeat.
    words = np.zeros(len(at), U)
    padded = np.concatenate((text, np.zeros(length + RUN + 16, np.uint8)))
    for k in range(0, length, 8):
        k = min(k, length - 8)
        w = np.lib.stride_tricks.sliding_window_view(padded, 8)[at + k]
        words = mix(words * U(0x9E3779B97F4A7C15) + np.ascontiguousarray(w).view(U)[:, 0])
    order = np.argsort(words, kind="stable")
    w = words[order]
    same = w[1:] == w[:-1]
    twice = np.zeros(len(w), bool)
    twice[1:] |= same
    twice[:-1] |= same
    pick = np.sort(order[twice])
    owner, offset, at = owner[pick], offset[pick], at[pick]
    if len(at) < 2:
        return
    width = -(-(length + RUN) // 8) * 8
    left = (rec["size"][owner] - offset).astype(np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[at] if len(padded) >= width else None
    rows = np.where(np.arange(width) < left[:, None], rows, 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}")[:, 0], kind="stable")
    rows, owner, offset, left, at = rows[order], owner[order], offset[order], left[order], at[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(left[1:], left[:-1]))
    before = np.where(offset > 0, padded[at - 1], 0).astype(np.int64)
    before[offset == 0] = -1
    lcps, chars = lcp.tolist(), before.tolist()
    low, high = rec["low"][owner].tolist(), rec["high"][owner].tolist()
    found: list[tuple[int, int, int, int]] = []
    stack: list[list[int]] = []  # common prefix, first suffix, smallest and greatest document, byte before (-1: they differ)
    for i, common in enumerate([*lcps, 0]):
        node = [common, i, low[i], high[i], chars[i]]
        while stack and stack[-1][0] > common:
            top = stack.pop()
            if node[2] < top[2]:
                top[2] = node[2]
            if node[3] > top[3]:
                top[3] = node[3]
            if top[4] != node[4]:
                top[4] = -1
            if top[4] == -1 and top[2] < top[3]:
                found.append((top[0], top[1], i, top[2]))
            node = top
        if common < length:
            stack.clear()
        elif stack and stack[-1][0] == common:
            top = stack[-1]
            top[2], top[3] = min(top[2], node[2]), max(top[3], node[3])
            if top[4] != node[4]:
                top[4] = -1
        else:
            stack.append([common, node[1], node[2], node[3], node[4]])
    for lo in range(0, len(found), 100_000):
        size, first, last, doc = (np.array(x, np.int64) for x in zip(*found[lo : lo + 100_000], strict=True))
        n = last - first + 1
        which = np.repeat(np.arange(len(n)), n)
        suffix = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        who = owner[suffix]
        gain = doc[which] < rec["high"][who]
        yield who[gain], offset[suffix[gain]], size[which[gain]], doc[which[gain]]


def _united(who: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping occurrences in one record that owe to one document, as one stretch of bytes."""
    order = np.lexsort((at, doc, who))
    who, at, size, doc = who[order], at[order], size[order], doc[order]
    if not len(who):
        return who, at, size, doc
    new = np.concatenate(([True], (who[1:] != who[:-1]) | (doc[1:] != doc[:-1])))
    lift = np.cumsum(new) * np.int64(1 << 32)
    reach = np.maximum.accumulate(at + size + lift)
    new[1:] |= (at + lift)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(who)) - 1
    return who[head], at[head], (reach[last] - lift[last]) - at[head], doc[head]


def _suffixes(length: int):
    def run(table: pa.Table) -> pa.Table:
        rec, own = _gathered(table, 0, _RECORD)
        text = np.frombuffer(b"".join(t for t, k in zip(table.column("data").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == 1), np.uint8)
        begin = np.cumsum(rec["size"]) - rec["size"]
        order = np.argsort(rec["m"], kind="stable")
        m = rec["m"][order]
        edge = np.flatnonzero(np.concatenate((np.ones(min(len(m), 1), bool), m[1:] != m[:-1])))
        alone = np.diff(np.concatenate((edge, [len(m)]))) == 1
        keep = ~np.repeat(alone, np.diff(np.concatenate((edge, [len(m)]))))
        order, m = order[keep], m[keep]
        work = np.cumsum(rec["size"][order] - length + 1) // SORT
        new = np.concatenate((np.ones(min(len(m), 1), bool), m[1:] != m[:-1]))
        group = np.cumsum(new) - 1
        lot = work[np.flatnonzero(new)][group] if len(m) else work
        cut = np.flatnonzero(np.concatenate((np.ones(min(len(m), 1), bool), lot[1:] != lot[:-1], np.ones(min(len(m), 1), bool))))
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            some = order[a:b]
            sizes = rec["size"][some].astype(np.int64)
            index = np.repeat(begin[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            for who, at, size, doc in maximal_repeats(rec[some], text[index], length):
                who, at, size, doc = _united(who, at, size, doc)
                span = np.empty(len(who), _SPAN)
                span["rid"], span["at"], span["size"], span["doc"] = rec["rid"][some][who], at, size, doc
                rows += [(p, SPANS, x.tobytes()) for p, _, x in _deal(own[some][who].astype(U), span, 1 << 31)]
        return _rows(rows, ("part", "kind", "data"))

    return run


def _remove(length: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        if not docs.num_rows:
            return schema.empty_table()
        part = _Part(docs, length)
        chunks, shared, hot, spans = _answers(back)
        settled = part.settled(chunks)
        edge = np.zeros(len(part.data) + 1, np.int32)
        np.add.at(edge, part.chunk_start[settled], 1)
        np.add.at(edge, part.chunk_end[settled], -1)
        seg = part.open_segments(settled, shared, hot)
        if seg.texts:
            doc, start, rid = part.ids[seg.doc], seg.start, seg.rid
            low = np.full(len(seg.texts), np.iinfo(np.int64).max)
            np.minimum.at(low, rid, doc)
            again = doc > low[rid]
            np.add.at(edge, start[again], 1)
            np.add.at(edge, start[again] + seg.size[again] + length - 1, -1)
            spans = spans[np.argsort(spans["rid"], kind="stable")]
            a, b = np.searchsorted(spans["rid"], rid), np.searchsorted(spans["rid"], rid, "right")
            n = b - a
            which = np.repeat(np.arange(len(rid)), n)
            x = spans[a[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
            later = doc[which] > x["doc"]
            where = start[which[later]] + x["at"][later]
            np.add.at(edge, where, 1)
            np.add.at(edge, where + x["size"][later], -1)
        np.cumsum(edge, out=edge)
        n_removed, n_spans, kept = [], [], []
        for k, (a, b) in enumerate(zip(part.base[:-1].tolist(), part.base[1:].tolist(), strict=True)):
            gone = edge[a:b] > 0
            n = int(gone.sum())
            n_removed.append(n)
            n_spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]) if n else 0)
            kept.append(part.data[a:b][~gone].tobytes() if n else part.texts[k])
        return pa.table([pa.array(part.ids), pa.array(np.diff(part.base)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, digest: bool = False, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document of a smaller id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left; with
    ``digest`` instead ``kept_sha256``), one row for each input row.  Strings are
    judged on the input, never cross documents, and may overlap.  A null text
    is empty; a text shorter than ``length`` is kept whole; rows with one id
    do not count as repeats of each other; a null id counts as the smallest; other columns are ignored,
    whatever their names; an empty table has no rows.
    """
    texts = slim(docs)
    # Texts are dealt again for each step, and each step's shuffle files go as its answers are written.
    scratch = Scratch(docs.sparkSession, "repeats", free=True)
    parts = parts_by_size(texts, part_bytes)
    buckets = -(-parts // 2)
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    entries = dealt.groupBy("part").applyInArrow(_emit(length, buckets), "bucket int, part int, kind int, data binary")
    answers = scratch.keep(entries.groupBy("bucket").applyInArrow(_compare(hot), "part int, kind int, data binary"), "answers")
    records = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_records(length, parts), "bucket int, part int, kind int, data binary")
    spans = scratch.keep(records.groupBy("bucket").applyInArrow(_suffixes(length), "part int, kind int, data binary"), "spans")
    out = dealt.groupBy("part").cogroup(answers.unionByName(spans).groupBy("part")).applyInArrow(_remove(length), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    kept = F.sha2("kept", 256).alias("kept_sha256") if digest else F.col("kept")
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", kept)
