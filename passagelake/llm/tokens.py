"""Byte-level BPE on whole blocks of texts, and edit-aware token counts.

Pre-token boundaries of a block are found with array operations on its code
points; each distinct pre-token is encoded once per block and remembered.
"""

from __future__ import annotations

import base64
import importlib
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .scratch import real_id, slim
from .textvec import U, _power, mix

#: The vocabulary's file; None: the installed public one of this name.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-token pattern that this vocabulary was made with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that are split together, and distinct pre-tokens that a worker remembers.
TOGETHER, REMEMBERED = 1 << 20, 400_000
LETTER, NUMBER, SPACE, OTHER = range(4)
# White space as the pattern's engine knows it (fixed values of the Unicode standard).
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_KIND: np.ndarray | None = None
_cp = np.random.Generator(np.random.PCG64(5)).integers(1, 2**64 - 1, 1 << 16, dtype=U)


def _kinds() -> np.ndarray:
    global _KIND
    if _KIND is None:
        kind = np.full(0x110000, OTHER, np.uint8)
        first = np.array([unicodedata.category(chr(k))[0] for k in range(0x110000)])
        kind[first == "L"], kind[first == "N"] = LETTER, NUMBER
        kind[_WHITE] = SPACE
        _KIND = kind
    return _KIND


@lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    import tiktoken

    path = vocabulary if "/" in vocabulary else importlib.import_module("public_tokenizers").path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pretoken_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in texts laid end to end, the texts beginning at ``first``."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[cp]
    head = np.zeros(n + 1, bool)
    head[first[first < n]] = True
    head[n] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # A run of white space before other text gives up its last character: a blank
    # joins what follows, anything else is a match of its own.
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start[before] = True
    blank = before & (cp == 32)
    start[1:][blank[:-1]] = False
    # Contractions begin at an apostrophe that is a match's whole start.
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        at = lambda k: np.where(quote + k < n, cp[np.minimum(quote + k, n - 1)], 0)
        same = lambda k: quote + k <= n - 1
        ends = np.searchsorted(first, quote, "right")
        end = np.concatenate((first, [n]))[ends]
        one = np.isin(at(1), [ord(c) for c in "stmd"]) & same(1) & (quote + 1 < end)
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (at(1) == ord(a)) & (at(2) == ord(b))
        two &= quote + 2 < end
        for q, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[q + 1] = False
            start[q + size - 1] = False
            after = q + size
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


class Coder:
    """Encodes texts with a per-worker memory of pre-tokens."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.piece = encoding(vocabulary)._core_bpe.encode_single_piece  # one pre-token's merges
        self.known: dict[int, bytes] = {}
        self.counts: dict[int, int] = {}

    def _distinct(self, cp: np.ndarray, start: np.ndarray):
        """Hash of each distinct pre-token, its first place, and each pre-token's number."""
        end = np.append(start[1:], len(cp))
        pre = np.zeros(len(cp) + 1, U)
        np.cumsum((_cp[cp & 0xFFFF] + cp.astype(U)) * _power("cp", 0xA0761D6478BD642F | 1, len(cp)), out=pre[1:])
        h = (pre[end] - pre[start]) * _power("cp-", pow(0xA0761D6478BD642F | 1, -1, 2**64), len(cp))[start]
        h = mix(h + (end - start).astype(U))
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return h, start[first], end[first], inverse

    def counted(self, text: str, cp: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token of ``text``, whose code points are ``cp``."""
        h, a, b, inverse = self._distinct(cp, start)
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        found, piece = self.counts, self.piece
        n = list(map(found.get, h.tolist()))
        for k in [k for k, x in enumerate(n) if x is None]:
            n[k] = found[int(h[k])] = len(piece(text[a[k] : b[k]].encode("utf-8", "surrogatepass")))
        return np.array(n, np.int32)[inverse]

    def encoded(self, text: str, cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, and how many each has."""
        h, a, b, inverse = self._distinct(cp, start)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found, piece = self.known, self.piece
        ids = list(map(found.get, h.tolist()))
        for k in [k for k, x in enumerate(ids) if x is None]:
            ids[k] = found[int(h[k])] = array("H", piece(text[a[k] : b[k]].encode("utf-8", "surrogatepass"))).tobytes()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        flat = np.frombuffer(b"".join(ids), np.uint16)
        begin = (np.cumsum(size) - size)[inverse]
        n = size[inverse]
        return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


def lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``TOGETHER`` code points."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or k == len(texts) - 1:
            yield lo, k + 1
            lo, size = k + 1, 0


class SegmentTree:
    """Sums over a text's pre-tokens: code points and tokens, level by level up to the root."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.levels = [np.stack((chars, tokens)).astype(np.int64)]
        self._lift(0)

    def _lift(self, first: int) -> None:
        """Rebuild the sums above the leaves from leaf ``first`` on."""
        k, low = 0, self.levels[0]
        while low.shape[1] > 1:
            first //= 2
            n = low.shape[1]
            up = np.empty((2, (n + 1) // 2), np.int64)
            if first:
                up[:, :first] = self.levels[k + 1][:, :first]
            np.add(low[:, 2 * first : n - 1 : 2], low[:, 2 * first + 1 :: 2], out=up[:, first : n // 2])
            if n % 2:
                up[:, -1] = low[:, -1]
            k += 1
            if k == len(self.levels):
                self.levels.append(up)
            else:
                self.levels[k] = up
            low = up
        del self.levels[k + 1 :]

    @property
    def total(self) -> tuple[int, int]:
        """(code points, tokens) of the whole text."""
        return tuple(self.levels[-1].sum(axis=1).tolist())

    def __len__(self) -> int:
        return self.levels[0].shape[1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The pre-token that holds code point ``char``, and where it begins; past the end: (leaves, code points)."""
        if char >= self.total[0]:
            return len(self), self.total[0]
        k, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            k *= 2
            if begin + level[0, k] <= char:
                begin += int(level[0, k])
                k += 1
        return k, begin

    def splice(self, lo: int, hi: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Put new leaves in place of ``lo:hi``; of the sums only those of changed leaves, or of shifted ones, are made anew."""
        new = np.stack((chars, tokens)).astype(np.int64)
        if new.shape[1] == hi - lo:
            self.levels[0][:, lo:hi] = new
            a, b = lo, max(lo, hi - 1)
            for k in range(1, len(self.levels)):
                a, b = a // 2, b // 2
                low = self.levels[k - 1][:, 2 * a : 2 * b + 2]
                self.levels[k][:, a : b + 1] = np.add.reduceat(low, np.arange(0, low.shape[1], 2), axis=1)
        else:
            self.levels[0] = np.concatenate((self.levels[0][:, :lo], new, self.levels[0][:, hi:]), axis=1)
            self._lift(max(0, min(lo, self.levels[0].shape[1] - 1)) if self.levels[0].shape[1] else 0)


#: A match of the pattern looks at most so many code points past its end.
LOOKAHEAD = 3
#: Code points behind an edit that are split first when looking for where the old boundaries are met again.
RESYNC = 32
_MATCH = regex.compile(PATTERN)


def edit(coder: Coder, tree: SegmentTree, text: str, at: int, drop: int, put: str) -> tuple[str, int]:
    """Replace ``text[at:at+drop]`` by ``put``; update the tree; return the text and how many pre-tokens were encoded anew.

    Splitting starts at the last boundary that the edit cannot have moved and ends at the
    first old boundary behind the edit that the new splitting also has: a match depends
    only on what follows its start, so from there on nothing has changed.
    """
    drop = min(drop, len(text) - at)
    new = text[:at] + put + text[at + drop :]
    lo, begin = tree.leaf_at(max(0, at - LOOKAHEAD))
    if begin >= at and lo:
        lo -= 1
        begin -= int(tree.levels[0][0, lo])
    shift, tail, span = len(put) - drop, at + len(put), RESYNC
    hi = None
    while hi is None:
        stop = min(len(new), tail + span)
        whole = stop == len(new)
        # Only matches that end clear of the piece's end are sure to be matches of the whole text.
        pieces = [m for m in _MATCH.findall(new[begin : stop + LOOKAHEAD])]
        leaf = where = None
        at_now = begin
        for k, piece in enumerate(pieces):
            if not whole and at_now > stop - LOOKAHEAD:
                break
            if at_now >= tail and at_now > begin:
                if leaf is None or where < at_now - shift:
                    leaf, where = tree.leaf_at(at_now - shift)
                if where == at_now - shift and leaf < len(tree):
                    hi, done = leaf, pieces[:k]
                    break
            at_now += len(piece)
        if hi is None and whole:
            hi, done = len(tree), pieces
        span *= 8
    sizes = np.fromiter(map(len, done), np.int64, len(done))
    tokens = np.fromiter((len(coder.piece(x.encode("utf-8", "surrogatepass"))) for x in done), np.int64, len(done))
    tree.splice(lo, hi, sizes, tokens)
    return new, len(done)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The edits of the counting query, from the text alone: its first line closed by a full stop, the word in its
    middle taken out, and a marker put before its last word.  (place, code points dropped, put in), each on the text so far."""
    if not text:
        return []
    line = text.find("\n")
    out = [(line if line >= 0 else len(text), 0, " .")]
    middle = len(text) // 2
    end = middle
    while end < len(text) and not text[end].isspace():
        end += 1
    shift = 2 if middle >= out[0][0] else 0
    out.append((middle + shift, end - middle, ""))
    now = len(text) + 2 - (end - middle)
    out.append((max(0, now - min(now, 9)), 0, " <mask> "))
    return out


_OUT = "id long, n_chars long, n_pretokens long, n_tokens long, n_edits int, n_reencoded long, n_chars_edited long, n_pretokens_edited long, n_tokens_edited long, depth int"


def _count(vocabulary: str, edits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            ids, texts, rows = batch.column("id").to_pylist(), batch.column("text").to_pylist(), []
            for lo, hi in lots(texts):
                joined = "".join(texts[lo:hi])
                flat = code_points(joined)
                size = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
                first = np.cumsum(size) - size
                starts = pretoken_starts(flat, first[size > 0])
                tokens = coder.counted(joined, flat, starts) if len(starts) else np.zeros(0, np.int32)
                chars = np.diff(np.append(starts, len(flat)))
                cut = np.searchsorted(starts, np.append(first, len(flat))).tolist()
                for k, text in enumerate(texts[lo:hi]):
                    tree = SegmentTree(chars[cut[k] : cut[k + 1]], tokens[cut[k] : cut[k + 1]])
                    n, (n_chars, n_tokens), depth, done = len(tree), tree.total, len(tree.levels), 0
                    todo = edits(text)
                    for at, drop, put in todo:
                        text, m = edit(coder, tree, text, at, drop, put)
                        done += m
                    rows.append((ids[lo + k], n_chars, n, n_tokens, len(todo), done, tree.total[0], len(tree), tree.total[1], depth))
            fields = [c.split() for c in _OUT.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32()}
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, edits=redactions) -> DataFrame:
    """Token counts of every text before and after edits, one row per row, without a shuffle.

    ``edits(text)`` gives (place, code points to drop, text to put in), applied in turn;
    only pre-tokens an edit can have touched are encoded anew (``n_reencoded``), the
    rest comes from the text's segment tree of ``depth`` levels.  A null or
    empty text has no tokens and gets no edits by default.
    """
    out = slim(docs).mapInArrow(_count(vocabulary, edits), _OUT)
    return out.select(real_id().alias("doc_id"), *[c for c in out.columns if c != "id"])
