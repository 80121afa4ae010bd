"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's documents are shuffled by a keyed hash and laid end to end as one
stream of words, cut into blocks of equal size.  The schedule's slots are the
points of the golden-ratio sequence, mapped through the cumulative target
shares to sources; a slot's rank within its source names the block it reads, and
ranks past the stream's end read it again.  By then a source is within the sequence's discrepancy of its
target, a few blocks: slots after the last point make up what is missing, and a source's last slots
read no further than its target, so every source, however small, gives its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, part_count

WEIGHTS = (5, 2, 1)
BUDGET, REPEAT = 1.5, 2.0
#: A block holds the 2**20th part of all words, LEAST words at least: the schedule has at most BUDGET * POINTS slots at any size.
LEAST, POINTS = 16, 1 << 20
#: Rows whose running sums one task of a window makes.
WINDOW_ROWS = 4_000
#: The golden ratio of the circle of 2**32 places: slot i is the point i * GOLDEN on it.
CIRCLE, GOLDEN = 1 << 32, 2654435769
#: Arcs of the circle by which points find their sources.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _pass_over(df: DataFrame, group: list[str], piece: str, order: list[str], amount: str, out: str) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows before, within ``group`` in the order of ``piece`` and then of ``order``.

    A group of any size is summed piece by piece: pieces first, then rows within a piece.
    """
    keys = ", ".join(group)
    by = f"{keys}, {piece}"
    sums = df.groupBy(*group, piece).agg(F.sum(amount).alias("_sum"))
    sums = sums.selectExpr(*group, piece, f"sum(_sum) over (partition by {keys} order by {piece}) - _sum as _base")
    inner = df.withColumn("_in", F.expr(f"sum({amount}) over (partition by {by} order by {', '.join(order)} rows unbounded preceding) - {amount}"))
    return inner.join(sums, [*group, piece]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")


def _numbered(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources in order of code points, null last, with their ``number`` from 0: sorted by ranges, so that any number of them will do."""
    ordered = sizes.repartitionByRange(part_count(scratch.spark), "is_null", "src").withColumn("piece", F.spark_partition_id())
    ordered = scratch.keep(ordered.withColumn("every", F.lit(0)).withColumn("one", F.lit(1)), "ordered")
    return _pass_over(ordered, ["every"], "piece", ["is_null", "src"], "one", "number").drop("one")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeat: float = REPEAT) -> DataFrame:
    """``src, is_null, source_size, number, piece, every, target`` from one row per source.

    Weights go round the sources in order (by code point, null last).  Targets share
    ``budget`` times all words by weight and stop at ``repeat`` times their source's words;
    what is cut off goes to the others by weight, until none is above its limit.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    s = _numbered(sizes, scratch).withColumn("w", w).withColumn("cap", F.lit(repeat) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w"))
    s = scratch.keep(s, "weighed")
    level, stopped = 0.0, -1
    while True:  # one number each: what the sources below the common level are cut to, and the weight of the others
        cut, open_, total, n = s.agg(F.sum(F.when(F.col("fill") < level, F.col("cap"))), F.sum(F.when(F.col("fill") >= level, F.col("w"))), F.sum("source_size"), F.count_if(F.col("fill") < level)).first()
        if n == stopped or not open_:
            break
        level, stopped = (budget * total - (cut or 0.0)) / open_, n
    target = F.when(F.col("fill") < level, F.col("cap")).otherwise(F.least(F.col("cap"), F.lit(level) * F.col("w")))
    return s.withColumn("target", target).drop("w", "cap", "fill")


def _schedule(sources: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """``number, rank, slot``: the source that each slot of the schedule reads, and how many of its slots come before."""
    aimed = _pass_over(sources.withColumn("aim", F.round("target").cast("long")), ["every"], "piece", ["number"], "aim", "before")
    all_ = aimed.agg(F.sum("aim")).first()[0] or 0
    n = -(-all_ // block)
    share = lambda c: F.floor(c / F.lit(max(all_, 1)) * CIRCLE).cast("long")
    spans = aimed.select("number", share(F.col("before")).alias("since"), share(F.col("before") + F.col("aim")).alias("upto")).where("upto > since")
    arc = CIRCLE // CELLS
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("since") / arc), F.floor((F.col("upto") - 1) / arc))))
    points = scratch.spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % CIRCLE).alias("x")).withColumn("cell", F.floor(F.col("x") / arc))
    drawn = points.join(spans, "cell").where("x >= since and x < upto")
    drawn = drawn.select("number", "slot", F.floor(F.col("slot") / WINDOW_ROWS).alias("piece"), F.lit(1).alias("one"))
    return scratch.keep(_pass_over(drawn, ["number"], "piece", ["slot"], "one", "rank").select("number", "rank", "slot"), "schedule")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeat: float = REPEAT, key: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot`` for each row; further columns of ``docs`` are not kept.

    ``size``: words of the text (null: 0).  ``taken``: words that the mix takes,
    repeats counted; a source's sum is its target, rounded, and no document has more
    than ``repeat`` times its size.  ``first_slot`` is the slot that first reads the document's beginning, null
    if none does.  Rows of one id are rows of their own, in the order of their texts' hashes; a null
    source is a source; texts without words and a corpus without words are not read; an empty table
    has no rows.  Reruns agree, for any partitioning.
    """
    return _read(docs, [], weights, budget, repeat, key).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def _read(docs: DataFrame, keep: list[str], weights, budget, repeat, key: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "mix")
    draw = F.md5(F.concat_ws(":", F.lit(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("is_null"),
        n_words(F.col("text")).alias("size"),
        draw.alias("draw"),
        *[F.col(c) for c in keep],
    )
    rows = scratch.keep(rows, "rows")
    sums = scratch.keep(rows.groupBy("src", "is_null").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    total, n = sums.agg(F.sum("source_size"), F.sum("n")).first()
    block = max(LEAST, (total or 0) // POINTS)
    sources = scratch.keep(source_targets(sums.drop("n"), scratch, weights, budget, repeat), "sources")
    schedule = _schedule(sources, block, scratch)

    # What a source's slots read, to the target's last word: whole rounds of its stream, and a rest.
    slots = schedule.groupBy("number").agg(F.count("*").alias("slots"))
    give = F.least(F.round("target").cast("long"), F.floor(F.lit(repeat) * F.col("source_size")))
    read = sources.join(slots, "number", "left").withColumn("give", F.when(F.col("source_size") > 0, give).otherwise(0)).withColumn("slots", F.coalesce("slots", F.lit(0)))
    # Slots that the points leave missing follow the last one, source by source.
    end = schedule.agg(F.max("slot")).first()[0]
    read = read.withColumn("more", F.greatest(F.lit(0), F.ceil(F.col("give") / block) - F.col("slots")))
    read = _pass_over(read, ["every"], "piece", ["number"], "more", "later").withColumn("later", F.col("later") + (0 if end is None else end + 1) - F.col("slots"))
    read = read.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("give") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("give") - F.col("rounds") * F.col("source_size"))
    placed = rows.join(read.select("src", "is_null", "number", "source_size", "target", "give", "rounds", "rest", "slots", "later"), ["src", "is_null"])
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))

    # The shuffled streams: where each document begins.
    lots = F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * max(1, -(-(n or 0) // WINDOW_ROWS)) / F.lit(1 << 32))
    placed = _pass_over(placed.where("size > 0").withColumn("lot", lots), ["number"], "lot", ["draw"], "size", "start")
    again = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    placed = placed.withColumn("taken", (F.col("rounds") * F.col("size") + again).cast("long"))
    placed = placed.withColumn("rank", F.when(F.col("start") < F.col("give"), F.floor(F.col("start") / block)))
    placed = placed.join(schedule, ["number", "rank"], "left")
    placed = placed.withColumn("first_slot", F.when(F.col("rank") >= F.col("slots"), F.col("later") + F.col("rank")).otherwise(F.col("slot")))
    out = ["doc_id", "size", "source_size", "target", "taken", "first_slot", *keep]
    return placed.select(*out).unionAll(none.select(*out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as ``taken`` holds its size, rounded; all columns kept, whatever their names.

    At most one document of a source lies across the end of what its slots read; it is in once more if half of its
    words are.  Documents without words are in once.
    """
    o = {"weights": WEIGHTS, "budget": BUDGET, "repeat": REPEAT, "key": "mix"} | options
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")
    out = _read(docs.select("doc_id", "source", "text", whole), ["_row"], o["weights"], o["budget"], o["repeat"], o["key"])
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    return out.select(F.explode(F.array_repeat("_row", times)).alias("_row")).select("_row.*")
