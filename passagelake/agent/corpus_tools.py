"""Read-only tools over an engine."""

from __future__ import annotations

from ..engine import MODES, Engine
from .tools import Registry, Tool


def hit(row) -> dict:
    """A search result as it goes into JSON."""
    return {"chunk_id": row["chunk_id"], "source": row["source"], "ordinal": row["ordinal"], "score": row["score"], "contributions": {k: round(v, 8) for k, v in row["contributions"].items()}, "citation": f"[{row['rank']}] {row['source']}#chunk{row['ordinal']}", "text": row["text"]}


def corpus_tools(engine: Engine, top_k: int = 5, most: int = 25) -> Registry:
    def search(query: str, top_k: int = top_k, mode: str = "hybrid") -> dict:
        """Search the passages; lexical finds exact names, vector what is alike, hybrid joins both."""
        if mode not in MODES:
            return {"error": "invalid_arguments", "message": f"mode must be one of {list(MODES)}", "got": mode}
        rows = engine.search(query, max(1, min(top_k, most)), mode).orderBy("rank").collect()
        return {"query": query, "mode": mode, "count": len(rows), "results": [hit(r) for r in rows]}

    def read_chunk(chunk_id: str) -> dict:
        """The whole text of one passage."""
        found = engine.store.chunk(chunk_id, engine.version).first()
        return {"error": "not_found", "chunk_id": chunk_id} if found is None else {c: found[c] for c in ("chunk_id", "source", "ordinal", "text", "title", "mime_type")}

    def read_source(source: str, max_chars: int = 8000) -> dict:
        """A document by its source, or by a file name that only one has."""
        return engine.read_source(source, max_chars)

    def list_sources(limit: int = 50) -> dict:
        """The documents, the newest first, with their numbers of passages."""
        rows = engine.store.sources(engine.version, max(1, min(limit, 500))).collect()
        return {"count": len(rows), "sources": [{"source": r["source"], "title": r["title"], "chunks": r["n_chunks"]} for r in rows]}

    def corpus_info() -> dict:
        """Sizes and settings of the index."""
        return engine.store.stats(engine.version).first().asDict()

    return Registry(map(Tool.of, (search, read_chunk, read_source, list_sources, corpus_info)))
