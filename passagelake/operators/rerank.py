"""Re-ranking of a pool by a model that reads query and passage together.

A model is built once for each task and scores pairs in batches of similar length, so that little of a batch is padding.  Texts are joined to
the pool only, and scores come back by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import terms

#: Scores of (query, passage) pairs; positive, the higher the better.
Scorer = Callable[[Sequence[tuple[str, str]]], np.ndarray]
#: Makes a scorer, in the task that uses it.
Build = Callable[[], Scorer]
BATCH = 64


@lru_cache(1 << 16)
def _word_vector(word: str, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    v = np.random.Generator(np.random.PCG64(seed)).normal(size=dim)
    return v / np.linalg.norm(v)


def _padded(texts: Sequence[Sequence[str]], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors of each text, and which places hold words."""
    longest = max(1, *map(len, texts)) if texts else 1
    x, held = np.zeros((len(texts), longest, dim)), np.zeros((len(texts), longest), bool)
    for k, words in enumerate(texts):
        held[k, : len(words)] = True
        for j, w in enumerate(words):
            x[k, j] = _word_vector(w, dim)
    return x, held


def attention_scores(pairs: Sequence[tuple[str, str]], dim: int = 64, heat: float = 12.0) -> np.ndarray:
    """Each query word attends over the passage's words; the mean agreement of word and what it attends to, as 0 to 1.  No words: 0."""
    q, has_q = _padded([terms(a) for a, _ in pairs], dim)
    p, has_p = _padded([terms(b) for _, b in pairs], dim)
    logits = np.where(has_p[:, None, :], heat * q @ p.transpose(0, 2, 1), -np.inf)
    top = np.where(has_p.any(axis=1)[:, None, None], logits.max(axis=2, keepdims=True), 0)
    weight = np.exp(logits - top)
    weight /= np.maximum(weight.sum(axis=2, keepdims=True), 1e-300)
    agree = (q * (weight @ p)).sum(axis=2)
    n = has_q.sum(axis=1)
    mean = np.where(has_q, agree, 0).sum(axis=1) / np.maximum(n, 1)
    return np.where((n > 0) & has_p.any(axis=1), (1 + mean) / 2, 0.0)


def build_reranker(spec: str | None, services: dict[str, Callable[[str], Build]] | None = None) -> Build | None:
    """A model by its name ``kind[:dim or model]``; ``services`` adds kinds.  None for no re-ranking and for ``overlap``, which needs no model."""
    kind, _, rest = (spec or "none").strip().partition(":")
    if kind.lower() in ("none", "overlap") and not rest:
        return None
    if kind.lower() == "attention":
        dim = int(rest or 64)
        if dim <= 0:
            raise ValueError(f"dim must be positive, got {dim}")
        return lambda: partial(attention_scores, dim=dim)
    if kind in (services or {}):
        return services[kind](rest)
    raise ValueError(f"unknown re-ranking {spec!r}")


def model_scores(pool: DataFrame, asked: DataFrame, passages: DataFrame, build: Build, batch: int = BATCH) -> DataFrame:
    """``query_id, key, score`` of a pool (query_id, key), from queries (query_id, query) and passages (key, text).

    A wrong number of scores, or one that is no finite number, is an error.  Scores of 0 and below mean: not to be shown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for b in batches:
            if not b.num_rows:
                continue
            score = score or build()
            pairs = list(zip(b.column("query").to_pylist(), (t or "" for t in b.column("text").to_pylist()), strict=True))
            order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
            out = np.zeros(len(pairs))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                got = np.asarray(score([pairs[k] for k in some]), np.float64)
                if got.shape != (len(some),) or not np.isfinite(got).all():
                    raise ValueError(f"expected {len(some)} finite scores, got {got.shape}")
                out[some] = got
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("key"), pa.array(out)], names=["query_id", "key", "score"])

    rows = pool.join(asked.select("query_id", "query"), "query_id").join(passages.select("key", "text"), "key").select("query_id", "key", "query", "text")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"query_id {kind['query_id']}, key {kind['key']}, score double")
