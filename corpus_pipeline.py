"""A training corpus from raw documents: five stages, each written before the next reads it.

Part of the subpackage passagelake.llm, whose operators the stages apply.  Every stage takes any table that
has the columns of ``documents`` and keeps all columns as they are, further ones too, whatever their names; null
ids and texts, empty texts, rows that repeat an id, and empty tables are rows like others (each operator's
docstring says what becomes of them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagelake.llm import decontaminate, minhash, mixing, order, toxicity
from passagelake.llm.scratch import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold.  Texts without words score 0 and stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 0.8 of their five-word shingles, one of the smallest id; rows without words stay."""
    return minhash.unique_documents(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out, so that each source's words meet its target."""
    return mixing.mixed_documents(docs)


def tokens_in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every fixed-length token sequence at its slot, in order of slots; ``order.write_shards`` makes raw files of such rows."""
    return order.training_order(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_items),
    ("source_mixing", mix_sources),
    ("training_order", tokens_in_training_order),
]
#: A trained network decides the first stage, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a written table that the next reads."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
