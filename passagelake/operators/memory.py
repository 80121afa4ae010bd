"""A conversation's messages within a token budget: the newest as they are, a digest of the older ones.

Messages are rows (conv_id, turn, role, text) and, where there, ``name`` of a tool and ``calls``, an array of
(name, arguments).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

HEAD = "Summary of earlier conversation:\n"
#: Order in which lines are let in: what tools found, what was asked of them, what was said.
FOUND, ASKED, SAID = 0, 1, 2
CALLS = "array<struct<name:string,arguments:string>>"


def tokens_of(text: str) -> int:
    """As :func:`passagelake.functions.text.text_tokens`, for one text."""
    wide = sum(0x4E00 <= c <= 0x9FFF or 0x3040 <= c <= 0x30FF or 0xAC00 <= c <= 0xD7AF or 0x3400 <= c <= 0x4DBF for c in map(ord, text))
    return -(-(len(text) - wide) // 4) + wide


def with_costs(messages: DataFrame) -> DataFrame:
    m = messages
    for name, kind in (("name", "string"), ("calls", CALLS)):
        if name not in m.columns:
            m = m.withColumn(name, F.lit(None).cast(kind))
    return m.withColumn("cost", tx.message_tokens(F.col("text"), F.col("calls")))


def split_by_budget(messages: DataFrame, budget: int, keep_ratio: float = 0.7) -> DataFrame:
    """Messages with ``cost``, ``kept`` and ``used``, the tokens of all that is kept.

    All are kept if they fit; else the newest as long as they fit the budget's ``keep_ratio``, the newest one always.
    """
    if budget <= 0 or not 0 < keep_ratio <= 1:
        raise ValueError(f"budget must be positive and keep_ratio in (0, 1], got {budget} and {keep_ratio}")
    conv = Window.partitionBy("conv_id")
    newest = conv.orderBy(F.col("turn").desc())
    m = with_costs(messages).withColumn("total", F.sum("cost").over(conv)).withColumn("so_far", F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("so_far") <= max(1, int(budget * keep_ratio))) | (F.row_number().over(newest) == 1)
    m = m.withColumn("kept", (F.col("total") <= budget) | fits)
    return m.withColumn("used", F.sum(F.when(F.col("kept"), F.col("cost"))).over(conv)).drop("total", "so_far")


def lines_of_message() -> Column:
    """What a digest can say about a message, as an array of (part, kind, line, cost): of a row with ``role, text, name, calls``."""
    calls = F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit("("), tx.clipped(c["arguments"], 80), F.lit(")"))), ", ")
    tool = F.col("role") == "tool"
    said = tx.first_clause(F.col("text"), 120)
    found = tx.first_clause(F.col("text"), 240)
    asked = F.when(F.size("calls") > 0, F.concat(F.lit("assistant requested tools: "), calls))
    told = F.when(tool, F.concat(F.lit("tool "), F.coalesce("name", F.lit("?")), F.lit(" returned: "), found)).otherwise(F.concat("role", F.lit(": "), said))
    told = F.when(said != "", told)

    def line(part: int, kind: Column, text: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), kind.alias("kind"), text.alias("line"), tx.text_tokens(F.concat(F.lit("- "), text)).alias("cost"))

    both = F.array(line(0, F.lit(ASKED), asked), line(1, F.when(tool, FOUND).otherwise(SAID), told))
    return F.filter(both, lambda x: x["line"].isNotNull() & F.coalesce(F.col("role") != "system", F.lit(False)))


def digest_lines(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, part, kind, line, cost`` of what a digest can say about messages; system messages say nothing."""
    return with_costs(messages).select("conv_id", "turn", F.inline(lines_of_message()))


def shortened(line: str, room: int) -> str | None:
    """A line cut at a blank to fit ``room`` tokens, with an ellipsis; none if it cannot."""
    cut = line[: max(1, room * 4)].rsplit(" ", 1)[0] + "…"
    return cut if tokens_of(f"- {cut}") <= room else None


def digests(messages: DataFrame, budgets: DataFrame) -> DataFrame:
    """``conv_id, text``: one digest for each conversation within its budget (conv_id, room), none where nothing fits.

    Lines are let in by kind, the newest first, until one does not fit; that one is cut short if this makes it fit.  A
    running sum finds them; they are put out in order of turns.
    """
    room = budgets.withColumn("room", F.col("room") - tokens_of(HEAD)).where("room >= 1")
    by = Window.partitionBy("conv_id").orderBy("kind", F.col("turn").desc(), F.col("part").desc())
    lines = digest_lines(messages).join(room, "conv_id").withColumn("upto", F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("fits", F.col("upto") <= F.col("room")).withColumn("misfits", F.sum(F.when(F.col("fits"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))

    @F.arrow_udf("string")
    def cut_short(line: pa.Array, left: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shortened(x, n) for x, n in zip(line.to_pylist(), left.to_pylist(), strict=True)], pa.string())

    edge = F.col("misfits") == 1
    lines = lines.where("misfits <= 1").withColumn("line", F.when(edge, cut_short(F.when(edge, F.col("line")), F.col("room") - (F.col("upto") - F.col("cost")))).otherwise(F.col("line"))).where("line is not null")
    told = F.array_sort(F.collect_list(F.struct("turn", "part", "line")))
    return lines.groupBy("conv_id").agg(F.concat(F.lit(HEAD), F.array_join(F.transform(told, lambda x: F.concat(F.lit("- "), x["line"])), "\n")).alias("text"))


def windows(messages: DataFrame, budget: int = 8000, keep_ratio: float = 0.7, summarize: bool = True, system: str | None = None) -> DataFrame:
    """``conv_id, turn, role, text``: what fits each conversation's budget, a digest of the rest before it.

    The digest is a system message at the turn before the first that is kept; ``system`` a prompt before all.
    """
    m = split_by_budget(messages, budget, keep_ratio)
    kept = m.where("kept").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    first = kept.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    out = kept
    if summarize:
        room = m.groupBy("conv_id").agg((F.lit(budget) - F.max("used")).alias("room"))
        said = digests(m.where("not kept").drop("cost", "kept", "used"), room)
        out = out.unionByName(said.join(first, "conv_id").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"), "text"))
    if system:
        out = out.unionByName(first.select("conv_id", (F.col("turn") - 2).alias("turn"), F.lit("system").alias("role"), F.lit(system).alias("text")))
    return out


def call_rows(calls: Sequence[tuple[str, dict]]) -> list[tuple[str, str]]:
    """Tool calls as the rows of ``calls``."""
    return [(name, json.dumps(arguments, sort_keys=True, ensure_ascii=False)) for name, arguments in calls]
