"""Passage retrieval and analytics on Spark DataFrames."""

from __future__ import annotations


def search(query, *, store: str, spark=None, top_k: int = 5, mode: str = "hybrid"):
    """The best passages of a stored corpus for one text, or for a DataFrame of queries (query_id, query)."""
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .sources.store import PassageStore

    spark = spark or SparkSession.builder.appName("passagelake").getOrCreate()
    at = PassageStore(spark, store)
    held = at.manifest()["embedder"]
    return Engine(at if held == at.embedder else PassageStore(spark, store, embedder=held)).search(query, top_k, mode)


def ask(query: str, *, store: str, spark=None, provider: str = "offline", top_k: int = 5):
    """A cited answer from a stored corpus: the run of the agent over its tools."""
    from pyspark.sql import SparkSession

    from .agent.corpus_tools import corpus_tools
    from .agent.loop import Agent
    from .agent.providers import default_providers
    from .engine import Engine
    from .sources.store import PassageStore

    spark = spark or SparkSession.builder.appName("passagelake").getOrCreate()
    engine = Engine(PassageStore(spark, store, embedder=PassageStore(spark, store).manifest()["embedder"]))
    return Agent(default_providers(spark).get(provider), corpus_tools(engine, top_k)).run(query)
