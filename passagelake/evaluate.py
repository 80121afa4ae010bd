"""How well each mode finds labelled passages, and how long queries take."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import MODES, Engine
from .operators import ranking

#: Authored documents and questions with the sources that answer them.
SAMPLE = [
    ("tide.md", "The harbour gates close two hours before high tide. Boats that miss them wait at the outer buoys until the water falls."),
    ("bread.md", "Rye dough rests overnight in a cold pantry. Its sourness comes from the starter, not from the flour."),
    ("bees.md", "A hive that loses its queen hums in a lower tone. Keepers listen for it before they open the box."),
    ("paper.md", "Rag paper outlasts wood pulp because it holds no lignin. Archives keep ledgers of rag paper flat and dry."),
]
QUESTIONS = [("when do the harbour gates close", ["tide.md"]), ("sour rye starter", ["bread.md"]), ("queen lost hive tone", ["bees.md"]), ("why does rag paper last", ["paper.md"]), ("kept dry or cold", ["paper.md", "bread.md"])]


def evaluate(engine: Engine, questions: Sequence[tuple[str, Sequence[str]]] = QUESTIONS, k: int = 5, modes: Sequence[str] = MODES) -> DataFrame:
    """``mode, n_queries, recall, precision, reciprocal_rank, hit, hybrid_wins``: means over the questions, by sources.

    Recall, precision and hits count the first ``k`` sources, the reciprocal rank goes by a list of ``2 * k`` passages.
    """
    spark = engine.spark
    asked = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(questions)], "query_id long, query string")
    good = spark.createDataFrame([(n, s) for n, (_, found) in enumerate(questions) for s in found], "query_id long, key string")
    per = []
    for mode in modes:
        hits = engine.search(asked, 2 * k, mode).select("query_id", F.col("source").alias("key"), "rank")
        m = ranking.retrieval_metrics(hits, good, k)
        per.append(m.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in ("recall", "precision", "reciprocal_rank", "hit")]).select(F.lit(mode).alias("mode"), "*"))
    all_ = reduce(DataFrame.unionAll, per).persist()
    return all_.crossJoin(ranking.hybrid_wins(all_))  # one row


def latencies(engine: Engine, queries: Sequence[str], top_k: int = 5, mode: str = "hybrid") -> dict[str, float]:
    """Seconds a query: mean, least, most, spread and the 95th percentile."""
    took = []
    for q in queries:
        began = time.perf_counter()
        engine.search(q, top_k, mode).collect()
        took.append(time.perf_counter() - began)
    took.sort()
    mean = sum(took) / len(took)
    return {"n": len(took), "mean": mean, "low": took[0], "high": took[-1], "spread": (sum((x - mean) ** 2 for x in took) / len(took)) ** 0.5, "p95": took[max(0, int(0.95 * len(took)) - 1)]}
