"""Memory windows of conversations that keep arriving: keyed state of bounded size.

What a window needs of a conversation is a summary: the messages that may still be kept, the digest lines that may still be
let in, its tokens in all, and the newest turn that is out for good.  More messages only push others out, so what is dropped never comes
back, and a summary holds about a budget's worth of messages and lines of each kind whatever the conversation's length.
Summaries merge in any order: a task sums up its own rows of a conversation before they are shuffled, late turns find their
place, and micro-batches end at the windows that :func:`passagelake.operators.memory.windows` has of the whole table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import memory

WINDOW = "array<struct<turn:bigint,role:string,text:string>>"
#: Rows of which a task makes summaries before it passes them on.
GATHER = 10_000
#: Where a message without a turn stands: before all others.
NO_TURN = -(1 << 63)


def _at(turn: int | None) -> int:
    return NO_TURN if turn is None else turn


class Memory:
    """Summaries for one budget.  A summary is a dict: ``total`` tokens, ``out`` (the newest turn that is not kept), ``kept``
    [turn, role, text, cost, lines], oldest first, and ``lines`` [kind, turn, part, line, cost], in the order they are let in."""

    def __init__(self, budget: int, keep_ratio: float = 0.7, system: str | None = None):
        if budget <= 0 or not 0 < keep_ratio <= 1:
            raise ValueError(f"budget must be positive and keep_ratio in (0, 1], got {budget} and {keep_ratio}")
        self.budget, self.system, self.limit = budget, system, max(1, int(budget * keep_ratio))

    def message(self, row: dict) -> dict:
        lines = [[x["kind"], row["turn"], x["part"], x["line"], x["cost"]] for x in row["lines"]]
        return {"total": row["cost"], "out": None, "kept": [[row["turn"], row["role"], row["text"], row["cost"], lines]], "lines": []}

    def merged(self, summaries: Iterable[dict]) -> dict:
        all_ = list(summaries)
        total = sum(s["total"] for s in all_)
        out = max((s["out"] for s in all_ if s["out"] is not None), default=None)
        kept = sorted((m for s in all_ for m in s["kept"]), key=lambda m: (_at(m[0]), m[1] or "", m[2] or ""), reverse=True)
        lines = [x for s in all_ for x in s["lines"]]
        if total > self.budget:
            so_far, stay = 0, []
            for m in kept:
                so_far += m[3]
                if not stay or (so_far <= self.limit and (out is None or _at(m[0]) > out)):
                    stay.append(m)
                else:
                    out = max(_at(m[0]), NO_TURN if out is None else out)
                    lines += m[4]
            kept = stay
        return {"total": total, "out": out, "kept": kept[::-1], "lines": self._near(lines)}

    def _near(self, lines: list) -> list:
        """Of each kind the newest lines up to the first that passes the budget: no window has room for another."""
        stay, sums = [], {}
        for x in sorted(lines, key=lambda x: (x[0], -_at(x[1]), -x[2])):
            if sums.get(x[0], 0) <= self.budget:
                sums[x[0]] = sums.get(x[0], 0) + x[4]
                stay.append(x)
        return stay

    def window(self, summary: dict) -> list[dict]:
        kept = summary["kept"]
        out = [{"turn": t, "role": role, "text": text} for t, role, text, _, _ in kept]
        before = None if kept[0][0] is None else kept[0][0] - 1
        if said := self._digest(summary):
            out.insert(0, {"turn": before, "role": "system", "text": said})
        if self.system:
            out.insert(0, {"turn": None if before is None else before - 1, "role": "system", "text": self.system})
        return out

    def _digest(self, summary: dict) -> str:
        room = self.budget - sum(m[3] for m in summary["kept"]) - memory.tokens_of(memory.HEAD)
        told = []
        for _, turn, part, line, cost in summary["lines"] if room >= 1 else []:
            if cost > room:
                cut = memory.shortened(line, room)
                told += [(_at(turn), part, cut)] if cut is not None else []
                break
            told.append((_at(turn), part, line))
            room -= cost
        return memory.HEAD + "\n".join(f"- {x}" for _, _, x in sorted(told)) if told else ""


def _summed(rules: Memory) -> Callable:
    """A task's rows as summaries, one for each conversation and ``GATHER`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        n, kind = 0, None

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([json.dumps(s) for s in held.values()], pa.string())], names=["conv_id", "summary"])
            held.clear()
            return made

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            of: dict = {}
            for row in batch.to_pylist():
                of.setdefault(row["conv_id"], []).append(rules.message(row))
            for c, found in of.items():
                held[c] = rules.merged([held[c], *found] if c in held else found)
            n += batch.num_rows
            if n >= GATHER:
                yield out()
                n = 0
        if held:
            yield out()

    return run


def remembered(messages: DataFrame, budget: int = 8000, keep_ratio: float = 0.7, system: str | None = None) -> DataFrame:
    """``conv_id, window``: of a stream of messages, the windows (JSON of ``WINDOW``) of the conversations that a batch changes.

    Turns may arrive in any order; a turn that comes twice counts twice, and where the edge of what is kept falls between
    rows of one turn it is open which of them stays.  A message without a turn stands before all others.
    """
    rules = Memory(budget, keep_ratio, system)
    m = memory.with_costs(messages).withColumn("lines", memory.lines_of_message())
    m = m.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "cost", "lines")
    kind = m.schema["conv_id"].dataType.simpleString()

    def kept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary = [json.loads(state.get[0])] if state.exists else []
        for frame in frames:
            summary = [rules.merged([*summary, *map(json.loads, frame["summary"])])]
        state.update((json.dumps(summary[0]),))
        yield pd.DataFrame({"conv_id": [key[0]], "window": [json.dumps(rules.window(summary[0]))]})

    summed = m.mapInArrow(_summed(rules), f"conv_id {kind}, summary string")
    return summed.groupBy("conv_id").applyInPandasWithState(kept, f"conv_id {kind}, window string", "summary string", "update", GroupStateTimeout.NoTimeout)


def remember(messages: DataFrame, path: str, checkpoint: str, budget: int = 8000, keep_ratio: float = 0.7, system: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Keep the windows of a stream's conversations below ``path``, a folder for each batch; one that is run again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = remembered(messages, budget, keep_ratio, system).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, conv_type: str = "string") -> DataFrame:
    """``conv_id, turn, role, text``: each conversation's newest window."""
    found = spark.read.schema(f"conv_id {conv_type}, window string, batch long").parquet(path)
    newest = found.groupBy("conv_id").agg(F.max_by("window", "batch").alias("window"))
    return newest.select("conv_id", F.inline(F.from_json("window", WINDOW)))
