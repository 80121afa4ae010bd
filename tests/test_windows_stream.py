import random

from pyspark.sql import functions as F

from passagelake.operators import memory
from passagelake.streaming import windows

SCHEMA = f"conv_id string, turn long, role string, text string, name string, calls {memory.CALLS}"


def talk(seed: int, n: int, conversations: int = 4) -> list[tuple]:
    """Messages of which a third is of one conversation, with tool calls, empty and null texts, and one that is longer than any budget."""
    r, out = random.Random(seed), []
    for turn in range(n):
        role = r.choice(["user", "assistant", "assistant", "tool", "system"])
        text = r.choice([None, "", " ".join(r.choices(["tide", "gate", "高い潮", "closes", "harbour-master"], k=r.randint(1, 25)))])
        calls = [("search", '{"query": "tides"}')] * r.randint(1, 2) if role == "assistant" and r.random() < 0.4 else None
        out.append(("hot" if r.random() < 0.34 else f"c{r.randrange(conversations)}", turn, role, text, "search" if role == "tool" else None, calls))
    return [*out, ("long", 0, "user", "a question", None, None), ("long", 1, "user", "wave " * 20_000, None, None)]


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.select("conv_id", "turn", "role", "text").collect()), key=str)


def test_batches_end_at_the_windows_of_the_whole(spark, tmp_path):
    said = talk(1, 160)
    random.Random(2).shuffle(said)  # turns come late, also after newer ones have pushed others out
    whole = spark.createDataFrame(said, SCHEMA)
    for budget, ratio in ((60, 0.7), (150, 0.3), (100_000, 0.7)):
        at = tmp_path / f"b{budget}"
        for k in range(3):  # a stopped query goes on where it was
            spark.createDataFrame(said[k::3], SCHEMA).repartition(2).write.mode("append").parquet(f"{at}/in")
            arriving = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
            windows.remember(arriving, f"{at}/out", f"{at}/log", budget, ratio, "be brief").awaitTermination()
        assert rows(windows.latest(spark, f"{at}/out")) == rows(memory.windows(whole, budget, ratio, system="be brief"))
    assert windows.latest(spark, f"{at}/out").where("conv_id = 'long'").count() == 3
    # The largest folder of a batch holds each conversation once.
    found = spark.read.parquet(f"{at}/out")
    assert found.groupBy("batch", "conv_id").count().where("count > 1").isEmpty() and found.select("batch").distinct().count() == 6


def test_an_empty_stream_has_no_windows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    windows.remember(arriving, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert windows.latest(spark, f"{tmp_path}/out").isEmpty()


def test_summaries_merge_in_any_order_and_stay_small(spark):
    said = [m for m in talk(3, 400) if m[0] == "hot"]
    rules = windows.Memory(80, 0.5)
    m = memory.with_costs(spark.createDataFrame(said, SCHEMA)).withColumn("lines", memory.lines_of_message())
    one = [rules.message(r.asDict(recursive=True)) for r in m.collect()]
    want = rules.merged(one)
    for seed in range(20):
        r, left = random.Random(seed), list(one)
        r.shuffle(left)
        while len(left) > 1:  # a random tree of merges
            k = r.randint(2, min(5, len(left)))
            left = [*left[k:], rules.merged(left[:k])]
            assert len(left[-1]["kept"]) <= 80 and len(left[-1]["lines"]) <= 3 * 80
        assert left[0] == want
    assert want["total"] == sum(s["total"] for s in one) == m.agg(F.sum("cost")).first()[0]
