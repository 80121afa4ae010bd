"""Search over a store's passages, many queries at once, and answers that cite them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answers, ranking, rerank
from .sources.store import NoVectors, PassageStore

log = logging.getLogger(__name__)
MODES = ("hybrid", "lexical", "vector")


@dataclass(frozen=True)
class SearchOptions:
    fusion: str = "rrf"
    rrf_k: int = ranking.RRF_K
    weights: dict[str, float] = field(default_factory=lambda: {"lexical": 0.7, "vector": 0.3})
    k1: float = ranking.K1
    b: float = ranking.B
    multiplier: int = 4
    min_score: float = 0.0
    rerank: str | None = None
    #: Further models for ``rerank``, by name.
    rerankers: dict[str, Callable[[str], rerank.Build]] | None = None

    def __post_init__(self):
        rerank.build_reranker(self.rerank, self.rerankers)
        ranking.validated_weights(self.weights, sorted(self.weights))
        if self.fusion.strip().lower() not in ("rrf", "dbsf", "weighted"):
            raise ValueError(f"unknown fusion in {self}")
        if self.multiplier < 1 or self.rrf_k <= 0 or self.min_score < 0:
            raise ValueError(f"multiplier and rrf_k must be positive, min_score not negative: {self}")


class Engine:
    """A store's passages as one version holds them; ``refresh`` takes up the newest."""

    def __init__(self, store: PassageStore, options: SearchOptions = SearchOptions()):
        self.store, self.options = store, options
        self.refresh()

    def refresh(self) -> int:
        self.version = self.store.version()
        self._lexical, self._chunks = self.store.lexical(self.version), self.store.chunks(self.version)
        return self.version

    def configure(self, **changes) -> SearchOptions:
        """Change search options; nothing is indexed anew, as scores are made when a query is asked."""
        self.options = replace(self.options, **changes)
        return self.options

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def asked(self, queries: DataFrame | str) -> DataFrame:
        """``query_id, query``, blank queries left out."""
        df = self.spark.createDataFrame([(0, queries)], "query_id long, query string") if isinstance(queries, str) else queries
        return df.where(F.trim(F.coalesce("query", F.lit(""))) != "").select("query_id", "query")

    def search(self, queries: DataFrame | str, top_k: int = 10, mode: str = "hybrid", source_filter: str | None = None, multiplier: int | None = None) -> DataFrame:
        """``query_id, rank, chunk_id, id, source, ordinal, score, contributions, text`` of the best passages of each query.

        Every retriever hands on a pool of ``top_k * multiplier``; ``source_filter`` (part of a source's name, in its
        case) and the least score are held against that pool, so fewer than ``top_k`` rows can be left.  Blank queries
        and a ``top_k`` below 1 find nothing.  Vectors that cannot be had leave the lexical list alone.
        """
        asked, o = self.asked(queries), self.options
        if top_k <= 0:
            asked = asked.limit(0)
        elif mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
        pool = max(top_k, top_k * (multiplier or o.multiplier), 1)
        lists = {}
        if mode != "vector":
            lists["lexical"] = ranking.topk(self._lexical.scores(ranking.query_terms(asked), o.k1, o.b, best=pool), pool)
        if mode != "lexical":
            try:
                lists["vector"] = self._nearest(asked, pool)
            except NoVectors as e:
                if mode == "vector":
                    raise
                log.warning("no vectors for the queries, lexical ranking only: %s", e)
        if len(lists) == 1:
            (name, only), = lists.items()
            top = only.select("query_id", "key", "score", F.create_map(F.lit(name), "score").alias("contributions"))
        else:
            ranked = [df.select("query_id", "key", "rank", "score", F.lit(n).alias("list")) for n, df in lists.items()]
            top = ranking.fused(ranked[0].unionByName(ranked[1]), o.weights, o.fusion, o.rrf_k)
            parts = F.map_from_arrays(F.array(*[F.lit(n) for n in sorted(lists)]), F.array(*[F.col(f"{n}_part") for n in sorted(lists)]))
            top = top.select("query_id", "key", "score", F.map_filter(parts, lambda _, v: v > 0).alias("contributions"))
        if o.rerank and o.rerank != "none":
            window = ranking.topk(top, pool)
            if model := rerank.build_reranker(o.rerank, o.rerankers):
                again = rerank.model_scores(window.select("query_id", "key"), asked, self._chunks.withColumnRenamed("chunk_id", "key"), model)
            else:
                again = ranking.overlap_scores(window.select("query_id", "key"), ranking.query_terms(asked), self._lexical.postings)
            top = window.drop("rank", "score").join(again, ["query_id", "key"]).withColumn("contributions", F.map_concat("contributions", F.create_map(F.lit(f"rerank:{o.rerank}"), "score")))
        top = ranking.topk(top, pool).join(self._chunks.withColumnRenamed("chunk_id", "key"), "key")
        if source_filter:
            top = top.where(F.col("source").contains(source_filter))
        if o.min_score > 0:
            top = top.where(F.col("score") >= o.min_score)
        top = ranking.topk(top.drop("rank"), top_k)
        return top.select("query_id", "rank", F.col("key").alias("chunk_id"), "id", "source", "ordinal", F.round("score", 8).alias("score"), "contributions", "text")

    def _nearest(self, asked: DataFrame, k: int) -> DataFrame:
        """Up to ``ranking.QUERY_BLOCK`` queries are embedded at once, as a service would be asked; more on the executors."""
        vectors = self.store.table("vectors", self.version).select(F.col("chunk_id").alias("key"), "embedding")
        rows = asked.limit(ranking.QUERY_BLOCK + 1).collect()
        if len(rows) > ranking.QUERY_BLOCK:
            many = self.store.embedded(asked.select("query_id", F.col("query").alias("text")), "query_id")
            return ranking.cosine_topk(vectors, many.select("query_id", F.col("embedding").cast("array<double>").alias("query_vector")), k)
        found = list(zip([r["query_id"] for r in rows], self.store.embed_queries([r["query"] for r in rows]) if rows else [], strict=True))
        kind = asked.schema["query_id"].dataType.simpleString()
        return ranking.cosine_topk(vectors, self.spark.createDataFrame(found, f"query_id {kind}, query_vector array<double>"), k)

    def ask(self, queries: DataFrame | str, top_k: int = 8, **options) -> DataFrame:
        """``query_id, answer``: sentences of the best passages with the numbers of their sources, and the sources."""
        asked = self.asked(queries)
        hits = self.search(asked, top_k, **options).persist()  # a few rows for each query, read several times
        return answers.cited(asked, hits.select("query_id", "source", "ordinal", "text", "score"))

    def read_source(self, source: str, max_chars: int = 8000) -> dict:
        """A document by its source, or by a file name that only one has."""
        if not source.strip():
            return {"error": "invalid_arguments", "message": "source must not be empty"}
        found = self.store.by_source(source, self.version).collect()
        if not found:
            base = lambda c: F.element_at(F.split(c, "/"), -1)
            found = self.store.documents(self.version).where(base(F.col("source")) == source.rpartition("/")[2]).orderBy("source").limit(11).collect()
            if len(found) > 1:
                return {"error": "ambiguous_source", "source": source, "candidates": [r["source"] for r in found[:10]], "message": "several documents have that file name; pass the whole source"}
            if not found:
                return {"error": "not_found", "source": source}
        doc, most = found[0], max(200, min(int(max_chars), 40_000))
        return {"source": doc["source"], "title": doc["title"], "total_chars": len(doc["text"]), "text": doc["text"][:most] + ("\n…[truncated]" if len(doc["text"]) > most else "")}

    def show(self, part: str) -> DataFrame:
        """The first document whose source holds ``part``."""
        return self.store.documents(self.version).where(F.col("source").contains(part)).orderBy("source", "id").limit(1)
