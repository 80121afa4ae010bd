"""Feature-hashing embeddings of texts, and checks on vectors from elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl

#: What an embedder is here: texts to a matrix of one row each.
Embedder = Callable[[Sequence[str]], np.ndarray]


#: Digests that are held one by one.
SLOTS = 4096


def _slots(features: pa.Array, dim: int, pair: bool = False) -> np.ndarray:
    """The buckets of words (or, salted, of pairs of words): 64 bits of BLAKE2b, little end first, modulo ``dim``."""
    copy, found = hashlib.blake2b(digest_size=8, salt=b"\x01" if pair else b"").copy, []
    _, upto, data = features.buffers()
    data, upto = data.to_pybytes() if data else b"", np.frombuffer(upto, np.int32)[features.offset :][: len(features) + 1].tolist() if len(features) else []
    for lo in range(0, len(features), SLOTS):
        out = []
        for a, b in pairwise(upto[lo : lo + SLOTS + 1]):
            h = copy()
            h.update(data[a:b])
            out.append(h.digest())
        found.append(b"".join(out))
    return (np.frombuffer(b"".join(found), "<u8") % np.uint64(dim)).astype(np.int64)


def slot(feature: str, dim: int, pair: bool = False) -> int:
    return int(_slots(pa.array([feature], pa.string()), dim, pair)[0])


def _vectors(words: pa.Array, word: np.ndarray, text: np.ndarray, n: int, dim: int, pair_weight: float) -> np.ndarray:
    """Vectors of ``n`` texts from distinct words, and the word and text of each occurrence, a text's words one after the other."""
    if dim <= 0 or pair_weight < 0:
        raise ValueError(f"dim must be positive and pair_weight not negative, got {dim} and {pair_weight}")
    out = np.bincount(text * dim + _slots(words, dim)[word], minlength=n * dim).astype(np.float64)
    if pair_weight and len(word):
        next_to = np.flatnonzero(text[1:] == text[:-1])
        pair, which = np.unique(word[next_to] * len(words) + word[next_to + 1], return_inverse=True)
        a, b = np.divmod(pair, len(words))
        met = _slots(pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), "\x1f"), dim, True)
        out += pair_weight * np.bincount(text[next_to] * dim + met[which], minlength=n * dim)
    out = out.reshape(n, dim)
    out = np.where(out > 0, 1 + np.log(np.where(out > 0, out, 1)), 0).astype(np.float32)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def embed_many(texts: Sequence[Sequence[str]], dim: int = 512, pair_weight: float = 0.5) -> np.ndarray:
    """Unit vectors of ``1 + ln(weight)`` per slot; words weigh 1, neighbouring pairs ``pair_weight``; zero without words."""
    found = pa.array([w for words in texts for w in words], pa.string()).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    return _vectors(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, len(texts), dim, pair_weight)


def embed(words: Sequence[str], dim: int = 512, pair_weight: float = 0.5) -> np.ndarray:
    return embed_many([words], dim, pair_weight)[0]


def hashing_embedder(dim: int = 512, pair_weight: float = 0.5) -> Embedder:
    return lambda texts: _vectors(*bl.cut(pa.array(texts, pa.string())), len(texts), dim, pair_weight)


def checked(found, n: int, dim: int | None = None) -> np.ndarray:
    """An embedder's answer as float32 rows; a wrong number of rows or columns, or a value that is no number, is an error."""
    m = np.asarray(found, np.float32)
    if m.ndim != 2 or len(m) != n or dim is not None and m.shape[1] != dim:
        raise ValueError(f"expected {n} vectors{f' of {dim}' if dim else ''}, got {m.shape}")
    if not np.isfinite(m).all():
        raise ValueError("a vector holds a value that is not a finite number")
    return m


def in_order(answers: Sequence[dict], n: int) -> list:
    """The vectors of a service that answers ``{"index": k, "embedding": [...]}`` in any order."""
    by = {a["index"]: a["embedding"] for a in answers}
    if sorted(by) != list(range(n)):
        raise ValueError(f"answers for {sorted(by)}, not for all of {n} texts")
    return [by[k] for k in range(n)]


def batches(items: Iterator, size: int) -> Iterator[list]:
    if size <= 0:
        raise ValueError(f"size must be positive, got {size}")
    items = iter(items)
    return iter(lambda: list(islice(items, size)), [])


def with_retries(call: Callable, tries: int = 3, wait: Callable[[float], None] | None = None) -> Callable:
    """``call`` again after failures that say they may pass (``retryable``), waiting twice as long each time."""
    import time

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception as e:
                if k + 1 == tries or not getattr(e, "retryable", isinstance(e, (OSError, TimeoutError))):
                    raise
                (wait or time.sleep)(0.5 * 2**k)

    return run


def build_embedder(spec: str, services: dict[str, Callable[..., Embedder]] | None = None) -> tuple[Embedder, str]:
    """An embedder by its name ``kind[:dim or model]`` and the identity that a store remembers; ``services`` adds kinds."""
    kind, _, rest = (spec or "hashing").partition(":")
    if kind.lower() == "hashing":
        dim = int(rest or 512)
        return hashing_embedder(dim), f"hashing:{dim}"
    if kind in (services or {}):
        return services[kind](rest), f"{kind}:{rest}"
    raise ValueError(f"unknown embedder {spec!r}")


#: Bytes of text that a task embeds at once, whatever the size of its batches.
TEXT_BYTES = 1 << 20


def runs(sizes: np.ndarray, most: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """First and next-to-last place of each run of neighbours of at most ``most`` together, or of a single larger one."""
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if len(sizes):
        yield first, len(sizes)


def hashed(docs: DataFrame, dim: int = 512, pair_weight: float = 0.5, key: str = "doc_id", embedder: Embedder | None = None) -> DataFrame:
    """``doc_id, embedding`` of documents (doc_id, text), in Arrow batches; ``embedder`` in place of the hashing one."""
    run_on = embedder or hashing_embedder(dim, pair_weight)

    def answer(texts: pa.Array) -> np.ndarray:
        return checked(run_on([t or "" for t in texts.to_pylist()]), len(texts))

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        found = [answer(texts.slice(a, b - a)) for a, b in runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))]
        m = checked(np.concatenate(found), len(texts)) if found else answer(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32)), pa.array(m.ravel()))

    return docs.select(key, run("text").alias("embedding"))
