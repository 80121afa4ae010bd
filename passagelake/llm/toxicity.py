"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, in numpy.

A token's input joins its word (a hashed embedding and the log odds of the word
among labelled texts) and its characters (the mean of hashed embeddings of its
byte 4-grams and 5-grams, and their highest log odds).  The network reads
overlapping windows of ``WINDOW`` tokens; a text's score is its highest window's.
Training alternates between scoring all windows of the sample and fitting the
windows that decide their texts, so labels of whole texts are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, give_back, real_id, slim, tidy
from .textvec import U, Words, arrow_texts, blocks, mix

WINDOW, STRIDE = 32, 24
#: Labelled rows to train on at most, of either label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
#: Bytes of a sampled text at most: longer ones are not learnt from, which bounds what the driver gathers at 128 MB.
LONGEST = 32 << 10
THRESHOLD = 0.7
HIDDEN, EMBED, BITS = 8, 4, 17
INPUT = 2 + 2 * EMBED
EPOCHS, STEPS, BATCH, RATE = 8, 150, 64, 0.025
#: The weight of all clean rows to that of all toxic ones.
CLEAN_WEIGHT = 2.0
#: Embeddings learn at this part of the rate, less by the square for samples under SLOW_ROWS: faster ones learn rare words by heart.
SLOW, SLOW_ROWS = 0.1, 2500
#: Windows that one step of the network reads together.
TOGETHER = 1024

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Tokens:
    """The tokens (letters, digits and all non-ASCII characters) of a block of texts, and its distinct ones."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, space=_BREAK)
        h, first, self.of = np.unique(w.hashes(), return_index=True, return_inverse=True) if len(w.start) else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.of = self.of.astype(np.int32)
        self.text_first = w.first
        self.word = (h >> U(64 - BITS)).astype(np.int64)
        size = (w.end - w.start)[first]
        # The distinct tokens with a blank before and after each.
        begin = np.cumsum(size + 1) - size
        line = np.full(int((size + 1).sum()) + 9, 32, np.uint8)
        source = np.repeat(w.start[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        line[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = w.buf[source]
        wide = np.lib.stride_tricks.sliding_window_view(line, 8)
        # Grams that begin at the blank before a token or in it and end by the blank after it.
        grams, owner = [], []
        for n in (4, 5):
            count = np.maximum(size + 2 - n + 1, 0)
            own = np.repeat(np.arange(len(size)), count)
            at = begin[own] - 1 + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            word8 = np.ascontiguousarray(wide[at]).view(U)[:, 0] if len(at) else np.zeros(0, U)
            grams.append((mix((word8 << U(8 * (8 - n))) + U(n)) >> U(64 - BITS)).astype(np.int64))
            owner.append(own)
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.gram, self.gram_of = grams[order].astype(np.int32), owner[order].astype(np.int32)
        self.gram_first = np.searchsorted(self.gram_of, np.arange(len(size)))
        self.gram_count = np.bincount(self.gram_of, minlength=len(size))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers (windows, WINDOW), -1 past a text's end; and the text of each window."""
        n = np.diff(self.text_first)
        count = np.where(n > WINDOW, 1 + -(-(n - WINDOW) // STRIDE), n > 0).astype(np.int64)
        text = np.repeat(np.arange(len(n)), count)
        start = self.text_first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        at = start[:, None] + np.arange(WINDOW)
        at[at >= self.text_first[text + 1][:, None]] = -1
        return at, text

    def inputs(self, m: dict[str, np.ndarray], odds: str = "", some: np.ndarray | None = None) -> np.ndarray:
        """The network's inputs for the distinct tokens, or for ``some`` of them."""
        word, grams, count = self.word, self.gram, self.gram_count
        if some is not None:
            word, grams, count = word[some], grams[self.grams_of(some)], count[some]
        x = np.zeros((len(word), INPUT), np.float32)
        x[:, 0] = m["word_odds" + odds][word]
        x[:, 2 : 2 + EMBED] = m["word"][word]
        have = count > 0
        if have.any():
            first = (np.cumsum(count) - count)[have]
            x[have, 1] = np.maximum.reduceat(m["gram_odds" + odds][grams], first)
            for k in range(EMBED):
                x[have, 2 + EMBED + k] = np.add.reduceat(m["gram"][grams, k], first) / count[have]
        return x

    def grams_of(self, some: np.ndarray) -> np.ndarray:
        """Where the grams of these distinct tokens stand, token after token."""
        n = self.gram_count[some]
        return np.repeat(self.gram_first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _odds(seen: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Shrunken log odds of the label for each bucket, from the sets of buckets of labelled texts."""
    count = np.zeros((2, 1 << BITS))
    total = np.zeros(2)
    for s, y in seen:
        count[y, s] += 1
        total[y] += 1
    lo = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    n = count.sum(axis=0)
    return (np.clip(lo, -4, 4) * n / (n + 4)).astype(np.float32) / 2


def _sig(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _read(px: np.ndarray, mask: np.ndarray, rec: np.ndarray, keep: list | None) -> np.ndarray:
    """States (T, B, H) of a gated recurrent layer over projected inputs (T, B, 3H)."""
    h = np.zeros((px.shape[1], HIDDEN), np.float32)
    out = np.empty((len(px), *h.shape), np.float32)
    for t in range(len(px)):
        g = h @ rec
        zr = _sig(px[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(px[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, g[:, 2 * HIDDEN :]))
        h = (n + z * (h - n)) * mask[t][:, None]
        out[t] = h
    return out


def _unread(dout: np.ndarray, mask: np.ndarray, rec: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``rec``."""
    dpx = np.empty((*dout.shape[:2], 3 * HIDDEN), np.float32)
    drec, dh = np.zeros_like(rec), np.zeros(dout.shape[1:], np.float32)
    for t in range(len(dout) - 1, -1, -1):
        h, z, r, n, gn = keep[t]
        d = (dh + dout[t]) * mask[t][:, None]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        dpx[t] = np.concatenate((dz, dr, dn), axis=1)
        dg = np.concatenate((dz, dr, dn * r), axis=1)
        drec += h.T @ dg
        dh = d * z + dg @ rec.T
    return dpx, drec


def _forward(m: dict, forth: np.ndarray, back: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows, from their projected inputs in reading order and (already reversed) backwards."""
    ka, kb = (None, None) if keep is None else ([], [])
    a = _read(forth, mask, m["rec_f"], ka)
    b = _read(back, mask[::-1], m["rec_b"], kb)[::-1]
    states = np.concatenate((a, b), axis=2)
    e = states @ m["attend"] + np.where(mask > 0, np.float32(0), np.float32(-1e9))
    e = np.exp(e - e.max(axis=0))
    e /= e.sum(axis=0)
    pooled = (states * e[:, :, None]).sum(axis=0)
    if keep is not None:
        keep.update(ka=ka, kb=kb, states=states, e=e, pooled=pooled)
    return pooled @ m["out"] + m["bias"][0]


def _scores(m: dict, tokens: Tokens, odds: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all windows, their tokens, their texts."""
    at, text = tokens.windows()
    x = tokens.inputs(m, odds)
    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    f = np.concatenate((x @ m["in_f"] + m["bias_f"], pad))
    b = np.concatenate((x @ m["in_b"] + m["bias_b"], pad))
    logit = np.empty(len(at), np.float32)
    for lo in range(0, len(at), TOGETHER):
        k = at[lo : lo + TOGETHER].T
        mask = (k >= 0).astype(np.float32)
        u = np.where(k >= 0, tokens.of[k], len(x))
        logit[lo : lo + TOGETHER] = _forward(m, f[u], b[u[::-1]], mask)
    return logit, at, text


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def n(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    m = {"word": n(1 << BITS, EMBED, scale=0.02), "gram": n(1 << BITS, EMBED, scale=0.02)}
    for d in "fb":
        m |= {f"in_{d}": n(INPUT, 3 * HIDDEN, scale=0.4), f"rec_{d}": n(HIDDEN, 3 * HIDDEN, scale=0.3), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
    return m | {"attend": n(2 * HIDDEN, scale=0.3), "out": n(2 * HIDDEN, scale=0.5), "bias": np.zeros(1, np.float32)}


def _gradients(m: dict, tokens: Tokens, at: np.ndarray, y: np.ndarray, weight: np.ndarray, odds: str) -> dict[str, np.ndarray]:
    used, where = np.unique(tokens.of[np.maximum(at, 0)], return_inverse=True)
    k = where.reshape(at.shape).T
    mask = (at.T >= 0).astype(np.float32)
    x = tokens.inputs(m, odds, used)
    keep: dict = {}
    logit = _forward(m, (x @ m["in_f"] + m["bias_f"])[k], (x @ m["in_b"] + m["bias_b"])[k[::-1]], mask, keep)
    d = ((_sig(logit) - y) * weight / len(y)).astype(np.float32)
    g = {"out": keep["pooled"].T @ d, "bias": d.sum(keepdims=True)}
    dp = d[:, None] * m["out"]
    s, e = keep["states"], keep["e"]
    de = (s * dp).sum(axis=2)
    de = e * (de - (e * de).sum(axis=0))
    ds = e[:, :, None] * dp + de[:, :, None] * m["attend"]
    g["attend"] = np.tensordot(de, s, axes=([0, 1], [0, 1])).astype(np.float32)
    dx = np.zeros_like(x)
    for name, dout, ks, index, msk in (("f", ds[:, :, :HIDDEN], keep["ka"], k, mask), ("b", ds[::-1, :, HIDDEN:], keep["kb"], k[::-1], mask[::-1])):
        dpx, g[f"rec_{name}"] = _unread(dout, msk, m[f"rec_{name}"], ks)
        flat = dpx.reshape(-1, 3 * HIDDEN)
        total = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(total, index.ravel(), flat)
        g[f"in_{name}"], g[f"bias_{name}"] = x.T @ total, flat.sum(axis=0)
        dx += total @ m[f"in_{name}"].T
    g["word"] = (tokens.word[used], dx[:, 2 : 2 + EMBED])
    count = tokens.gram_count[used]
    own = np.repeat(np.arange(len(used)), count)
    g["gram"] = (tokens.gram[tokens.grams_of(used)], dx[own, 2 + EMBED :] / np.maximum(count, 1)[own][:, None])
    return g


def train(texts: list[bytes], labels: np.ndarray, seed: int = 3) -> dict[str, np.ndarray] | None:
    """A model from labelled texts; None unless both labels occur."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    m = _start(rng)
    fold = np.empty(len(texts), np.int64)  # log odds that a text trains on come from the other fold
    for y in (0, 1):
        k = rng.permutation(np.flatnonzero(labels == y))
        fold[k] = np.arange(len(k)) % 2
    lots = []
    words, grams = [], []
    for f in (0, 1):
        mine = np.flatnonzero(fold == f).tolist()
        for numbers, some in blocks(mine, [texts[k] for k in mine]):
            t = Tokens(some)
            lots.append((t, np.array(numbers), f))
            for j, k in enumerate(numbers):
                own = np.unique(t.of[t.text_first[j] : t.text_first[j + 1]])
                words.append((np.unique(t.word[own]).astype(np.int32), int(labels[k]), f))
                grams.append((np.unique(t.gram[t.grams_of(own)]).astype(np.int32), int(labels[k]), f))
    for name, seen in (("word_odds", words), ("gram_odds", grams)):
        m[name] = _odds([(s, y) for s, y, _ in seen])
        for f in (0, 1):
            m[f"{name}{f}"] = _odds([(s, y) for s, y, g in seen if g != f])
        seen.clear()  # the sets of all texts outweigh the model many times
    n_texts = len(texts)
    del texts
    give_back()
    weight = np.array([CLEAN_WEIGHT / (labels == 0).sum(), 1 / (labels == 1).sum()]) * len(labels) / (1 + CLEAN_WEIGHT)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.items() if "odds" not in k}
    step = 0
    slow = SLOW * min(1.0, n_texts / SLOW_ROWS) ** 2
    epochs = max(EPOCHS, -(-STEPS * BATCH // n_texts))  # a small sample is read more often
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.001
        for t, numbers, f in lots:
            if epoch:
                logit, at, text = _scores(m, t, str(f))
            else:  # at first the windows of the highest log odds
                at, text = t.windows()
                x = t.inputs(m, str(f))
                logit = np.where(at >= 0, np.maximum(x[:, 0], x[:, 1])[t.of[np.maximum(at, 0)]], -9).max(axis=1) if len(at) else np.zeros(0)
            if not len(at):
                continue
            order = np.lexsort((-logit, text))
            top = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))]
            clean = np.flatnonzero(labels[numbers[text]] == 0)
            some = rng.choice(clean, min(len(clean), len(top) // 4), replace=False) if len(clean) else top[:0]
            picks = rng.permutation(np.concatenate((top, some)))
            for lo in range(0, len(picks), BATCH):
                p = picks[lo : lo + BATCH]
                y = labels[numbers[text[p]]]
                step += 1
                for k, g in _gradients(m, t, at[p], y.astype(np.float32), weight[y].astype(np.float32), str(f)).items():
                    _update(m[k], moment[k], g, rate * (slow if isinstance(g, tuple) else 1), step)
    return {k: v for k, v in m.items() if not k.endswith(("odds0", "odds1"))}


def _update(value: np.ndarray, moment: list[np.ndarray], g, rate: float, step: int) -> None:
    """One step of Adam; embedding gradients come as (rows, values) and touch only those rows."""
    if isinstance(g, tuple):
        rows, where = np.unique(g[0], return_inverse=True)
        total = np.zeros((len(rows), value.shape[1]), np.float32)
        np.add.at(total, where, g[1])
        g = total
    else:
        rows = slice(None)
    a, b = moment
    a[rows] = 0.9 * a[rows] + 0.1 * g
    b[rows] = 0.99 * b[rows] + 0.01 * g * g
    value[rows] -= (rate * (a[rows] / (1 - 0.9**step)) / (np.sqrt(b[rows] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def score_texts(m: dict[str, np.ndarray] | None, texts: list[bytes]) -> np.ndarray:
    """Scores from 0 to 1: the highest of a text's windows; 0 for a text without tokens or without a model."""
    out = np.zeros(len(texts))
    if m is None:
        return out
    for numbers, some in blocks(list(range(len(texts))), texts):
        t = Tokens(some)
        logit, _, text = _scores(m, t)
        best = np.full(len(some), -np.inf)
        np.maximum.at(best, text, logit.astype(np.float64))
        out[numbers] = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -50, 50))), 0)
    return out


def held_out(doc_id):
    """The fold whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """A model from at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled rows, drawn by a hash of their ids.

    Labels other than 0 and 1, null ids and ids with both labels are left out, and so are drawn texts of over
    ``LONGEST`` bytes.  Of rows that repeat an id the smallest text counts.
    """
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(labels["doc_id"]))
    rows = rows.groupBy(rows["doc_id"].cast("long").alias("id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    few = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))]
    few = few[0].unionAll(few[1]).select("id", "toxic")
    # Bounded: at most the sampled rows, by their limit.
    short = slim(docs).where(F.octet_length("text") <= LONGEST)
    got = short.join(F.broadcast(few), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    got.sort(key=lambda r: r["id"])
    known = np.array([r["toxic"] for r in got], np.int64)
    handed = [[r["text"].encode() for r in got]]
    del got
    give_back()
    model = train(handed.pop(), known)  # which frees the texts once it has their tokens
    give_back()
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` for every whole text, in one pass without a shuffle; a column that has the name already is an error."""
    if name in docs.columns:
        raise ValueError(f"{name!r} is a column already")
    return _scored(docs, model).select("row.*", F.col("score").alias(name))


def clean_documents(docs: DataFrame, model: dict[str, np.ndarray] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose whole text scores below ``threshold``; null and empty texts stay."""
    return _scored(docs, model).where(F.col("score") < threshold).select("row.*")


def _scored(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """``(row, score)``: every row as a struct, whatever its columns are called."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, by BITS and EMBED
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts = [t or b"" for t in rows.field("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows, pa.array(score_texts(held.value, texts))], names=["row", "score"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, with a model learnt from the labels of the other folds.

    A null or empty text scores 0, as do all texts where no labels of both kinds
    are left to learn from.  A null id is not held out.  Rows that repeat an id are scored each by its text; texts of any
    length are read whole, window by window.  Other columns are ignored, whatever their names; an empty table has no rows.
    """
    rows = slim(docs)
    out = score(rows, fit(docs, labels))
    return out.select(real_id().alias("doc_id"), F.coalesce(held_out(real_id()), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
