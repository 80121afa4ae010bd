"""Settings in layers: defaults, a JSON file, environment variables, arguments; later layers win."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from .engine import SearchOptions
from .operators.chunking import ChunkOptions
from .operators.ranking import B, K1, RRF_K


@dataclass(frozen=True)
class Config:
    store: str = "passages"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embedder: str = "hashing:512"
    provider: str = "offline"
    top_k: int = 5
    mode: str = "hybrid"
    fusion: str = "rrf"
    lexical_weight: float = 0.7
    vector_weight: float = 0.3
    rrf_k: int = RRF_K
    k1: float = K1
    b: float = B
    rerank: str | None = None
    multiplier: int = 4
    min_score: float = 0.0
    token: str | None = None

    def __post_init__(self):
        self.chunks(), self.search()
        if self.top_k < 1 or self.mode not in ("hybrid", "lexical", "vector"):
            raise ValueError(f"top_k must be positive and mode a known one, got {self.top_k} and {self.mode!r}")

    def chunks(self) -> ChunkOptions:
        return ChunkOptions(self.chunk_size, self.chunk_overlap)

    def search(self) -> SearchOptions:
        weights = {"lexical": self.lexical_weight, "vector": self.vector_weight}
        return SearchOptions(fusion=self.fusion, rrf_k=self.rrf_k, weights=weights, k1=self.k1, b=self.b, rerank=self.rerank, multiplier=self.multiplier, min_score=self.min_score)


def _typed(name: str, value):
    kind = type(next(f.default for f in fields(Config) if f.name == name))
    return value if value is None or kind is type(None) else kind(value)


def load(file: str | Path | None = None, environment: Mapping[str, str] = os.environ, prefix: str = "PASSAGELAKE_", **given) -> Config:
    """Unknown names in the file or among the arguments are errors; other environment variables are not looked at."""
    names = [f.name for f in fields(Config)]
    layers = [json.loads(Path(file).read_text()) if file else {}, {n: environment[prefix + n.upper()] for n in names if prefix + n.upper() in environment}, {k: v for k, v in given.items() if v is not None}]
    out = Config()
    for layer in layers:
        if unknown := sorted(layer.keys() - set(names)):
            raise ValueError(f"unknown settings {unknown}")
        out = replace(out, **{k: _typed(k, v) for k, v in layer.items()})
    return out


def save(config: Config, file: str | Path) -> None:
    """All settings but the token."""
    Path(file).write_text(json.dumps({k: v for k, v in asdict(config).items() if k != "token"}, indent=2))
