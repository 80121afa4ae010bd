"""Extractive answers from ranked passages, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import query_terms

SENTENCES, EVIDENCE, LEAST, LEADING = 6, 8, 20, 24
NOTHING = "Nothing that was indexed matches the question."
RESULTS = "struct<results:array<struct<source:string,ordinal:string,text:string,content:string,score:string,chunk_id:string>>>"


def parsed_evidence(results: DataFrame, accepted: tuple[str, ...] = ("search",)) -> DataFrame:
    """``query_id, source, ordinal, text, score, rank`` from tool results (query_id, name, content as JSON).

    Rows of other tools, content that is no such JSON, and entries without text or whose score or ordinal is no finite
    number are left out.  Ranks from 0 go by score, source, ordinal.
    """
    rows = results.where(F.col("name").isin(*accepted) | F.col("name").isNull())
    e = rows.select("query_id", F.explode(F.from_json("content", RESULTS)["results"]).alias("e")).select("query_id", "e.*")
    text = F.trim(F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.col("content"), F.lit("")))
    number = lambda c, kind: F.coalesce(F.expr(f"try_cast({c} as {kind})"), F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(0).cast(kind)))
    e = e.select("query_id", F.coalesce("source", F.lit("unknown")).alias("source"), number("ordinal", "long").alias("ordinal"), text.alias("text"), number("score", "double").alias("score"))
    e = e.where((F.col("text") != "") & F.col("ordinal").isNotNull() & (F.abs("score") < float("inf")) & ~F.isnan("score"))
    return ordered_evidence(e)


def ordered_evidence(evidence: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source", "ordinal", "text")
    return evidence.withColumn("rank", F.row_number().over(w).cast("long") - 1)


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？;；\n])\s+"), tx.strip), lambda s: s != "")


def chosen_sentences(asked: DataFrame, evidence: DataFrame, most: int = SENTENCES) -> DataFrame:
    """``query_id, n, rank, position, score, citation, sentence``: those that answer, in order of passages.

    A sentence scores 1 / (1 + its passage's rank), the share of the query's terms that the passage holds, and 0.02 less
    for each sentence before it; passages without any term are left out.  Without such sentences the first one of
    ``LEADING`` characters of each passage answers.
    """
    e = evidence.where(F.col("rank") < EVIDENCE)
    q = query_terms(asked)
    own = e.select("query_id", "rank", F.explode(F.array_distinct(tx.any_words(F.col("text")))).alias("term"))
    hits = own.join(q, ["query_id", "term"]).groupBy("query_id", "rank").agg(F.count("*").alias("hits"))
    size = q.groupBy("query_id").agg(F.count("*").alias("n_asked"))
    e = e.join(hits, ["query_id", "rank"], "left").join(size, "query_id", "left").fillna(0, ["hits", "n_asked"])
    s = e.select("query_id", "rank", "hits", "n_asked", F.posexplode(_sentences(F.col("text"))).alias("position", "sentence")).where(~tx.structural(F.col("sentence")))
    cover = F.when(F.col("n_asked") > 0, F.col("hits") / F.col("n_asked")).otherwise(0.0)
    good = s.where((F.length("sentence") >= LEAST) & ((F.col("hits") > 0) | (F.col("n_asked") == 0)))
    good = good.withColumn("score", F.round(1.0 / (1 + F.col("rank")) + cover - F.col("position") * 0.02, 9))
    lead = s.where(F.length("sentence") >= LEADING).groupBy("query_id", "rank").agg(F.min(F.struct("position", "sentence")).alias("m")).where(F.col("rank") < most)
    lead = lead.select("query_id", "rank", "m.position", "m.sentence", (1.0 / (1 + F.col("rank"))).alias("score")).join(good.select("query_id").distinct(), "query_id", "left_anti")
    s = good.select("query_id", "rank", "position", "sentence", "score").unionByName(lead)
    s = s.withColumn("same", F.substring(F.regexp_replace(F.lower("sentence"), r"(?U)\W+", ""), 1, 120)).where("same <> ''")
    s = s.withColumn("f", F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.col("score").desc(), "rank", "position"))).where("f = 1")
    place = Window.partitionBy("query_id").orderBy("rank", "position")
    s = s.withColumn("n", F.row_number().over(place).cast("long")).where(F.col("n") <= most)
    s = s.withColumn("citation", F.dense_rank().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    return s.select("query_id", "n", "rank", "position", "score", "citation", "sentence")


def cited(asked: DataFrame, hits: DataFrame, most: int = SENTENCES, nothing: str = NOTHING) -> DataFrame:
    """``query_id, answer`` from hits (query_id, source, ordinal, text, score): a line for each sentence, then the sources."""
    evidence = ordered_evidence(hits)
    s = chosen_sentences(asked, evidence, most)
    lines = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.format_string("%s [%d]", "sentence", "citation").alias("line")))).alias("l"))
    used = s.select("query_id", "rank", "citation").distinct().join(evidence, ["query_id", "rank"])
    note = F.format_string("  [%d] %s (chunk %d, score %.4f)", "citation", "source", "ordinal", "score")
    notes = used.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation", note.alias("line")))).alias("s"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    answer = F.concat(text(F.col("l")), F.lit("\n\nSources:\n"), text(F.col("s")))
    return asked.select("query_id").join(lines.join(notes, "query_id"), "query_id", "left").select("query_id", F.coalesce(answer, F.lit(nothing)).alias("answer"))
