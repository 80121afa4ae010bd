"""Vectorised scanning and hashing of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are scanned together; a longer single text is scanned alone.
BLOCK = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        step = np.full(size, base, U)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * BLOCK:
            _powers[kind] = have
    return have[:n]


def blocks(ids: list[int], texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of texts of about ``limit`` bytes."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield ids[lo : k + 1], texts[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def arrow_texts(batch: pa.RecordBatch | pa.Table, text: str = "text") -> list[bytes]:
    return batch.column(text).cast(pa.binary()).to_pylist()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts: spans, text numbers and hashes."""

    def __init__(self, texts: list[bytes], lower: bool = True, space: np.ndarray = _SPACE):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw, self.buf = raw, (_LOWER[raw] if lower else raw)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        word = ~space[raw]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        #: The first word of each text, and one past the last word of the last.
        self.first = np.concatenate((np.searchsorted(self.start, self.doc_start), [len(self.start)]))

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        pre = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.buf] * _power("up", _BASE, n), out=pre[1:])
        h = (pre[self.end] - pre[self.start]) * _power("down", _BASE_INV, n)[self.start]
        return mix(h + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(words: Words, width: int) -> list[np.ndarray]:
    """Per text the distinct hashes of its ``width``-word shingles; of a shorter text its whole sequence; sorted."""
    w, first = words.hashes(), words.first
    factor = seeds(width, 77) | U(1)
    n = max(0, len(w) - width + 1)
    s = np.zeros(n, U)
    for k in range(width):
        s += w[k : k + n] * factor[k]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            short = w[a:b]
            out.append(mix((short * factor[: b - a]).sum(dtype=U, keepdims=True) + U(int(b - a))))
        else:
            out.append(np.zeros(0, U))
    return out


def set_hash(h: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of hashes apart, as two signed longs."""
    a = np.add.reduce(mix(h + U(0x1234567)), dtype=U)
    b = np.add.reduce(mix(h ^ U(0x5851F42D4C957F2D)) * U(0xDA942042E4DD58B5), dtype=U)
    return int(np.asarray(a, U).view(np.int64)), int(np.asarray(b, U).view(np.int64))


def minhashes(flat: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` minima of 32 bits for each non-empty run of ``flat`` that begins at ``starts``."""
    out = np.empty((len(starts), n), np.uint32)
    if not len(starts):
        return out
    add, mul = seeds(n, seed), seeds(n, seed + 1) | U(1)
    for k in range(n):
        v = ((flat ^ add[k]) * mul[k]) >> U(32)
        out[:, k] = np.minimum.reduceat(v.astype(np.uint32), starts)
    return out
