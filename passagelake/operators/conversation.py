"""Bounded conversation memory over rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import message_tokens


def session_listing(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))


def tail(messages: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def compaction_tail(messages: DataFrame, budget: int, keep_ratio: float = 0.7) -> DataFrame:
    """Messages that stay: all if they fit the budget, else the newest up to a share of it, the newest one always."""
    m = messages.withColumn("cost", message_tokens(F.col("text")))
    conv = Window.partitionBy("conv_id")
    newest = conv.orderBy(F.col("turn").desc())
    m = m.withColumn("total", F.sum("cost").over(conv)).withColumn("so_far", F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("n", F.row_number().over(newest))
    keep = (F.col("total") <= budget) | (F.col("so_far") <= max(1, int(budget * keep_ratio))) | (F.col("n") == 1)
    return m.where(keep).select("conv_id", "turn", "role", "cost", F.col("so_far").alias("cost_so_far"))


def after_last_user(messages: DataFrame) -> DataFrame:
    """Messages after each conversation's last user turn."""
    last = messages.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user"))
    return messages.join(last, "conv_id").where("last_user is not null and turn > last_user").select("conv_id", "turn", "role")


def transcript(messages: DataFrame) -> DataFrame:
    """Each conversation as one text of ``role: text`` lines in the order of turns."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
