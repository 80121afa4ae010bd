"""F2 of round 4: postings by impact are laid out run by run where documents lie, and none is shuffled."""

import random

import pytest
from pyspark import cloudpickle

from passagelake.operators import blocks, impacts, ranking
from passagelake.sources.shared import Folder


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "TEXT", 1500)
    cloudpickle.register_pickle_by_value(blocks)
    yield
    cloudpickle.unregister_pickle_by_value(blocks)


@pytest.mark.parametrize(("run", "asked_most"), [(500, 1 << 16), (1 << 21, 1 << 16), (500, 3)])
def test_runs_find_what_the_full_scan_finds(spark, small, monkeypatch, run, asked_most):
    for module, name, value in ((impacts, "HEAD", 16), (impacts, "CLASSES", 8), (impacts, "BUCKETS", 3), (impacts, "SHELF", 64), (impacts, "RUN", run), (ranking, "ASKED", asked_most)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(120)], k=rng.randint(0, 40)))) for k in range(600)]
    rows += [(600 + k, rows[3][1]) for k in range(30)] + [(None, "w1 w1 w2 w90"), (990, None), (991, "!"), (992, "Straße w5 w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    plans = []
    real = impacts._written
    monkeypatch.setattr(impacts, "_written", lambda df, path, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, path, *a))
    folder = Folder(spark, "test", free=True)
    full = ranking.LexicalIndex.of_texts(docs, keep=folder.keep)
    index = impacts.ImpactIndex.build(full, f"{folder.root}/impacts")
    assert len(plans) == 2 and "Exchange" not in "".join(plans)
    runs = index.blocks.where("tier = 0").count() / 3
    tasks = index.forward.select("shelf").distinct().count()  # at most
    assert runs > 10 if run == 500 else runs <= tasks
    each = lambda df: sorted(map(str, df.select("term", "key", "tf", "dl").collect()))
    assert each(index._postings(index.blocks, None)) == each(full.postings) == each(blocks.postings(index.forward.drop("shelf")))
    asked = [(1, "w0 w1 w2 w3"), (2, "w7"), (3, "w119 w90 w1"), (4, "unknown"), (5, ""), (6, "w5 w60 unknown w0 strasse")]
    wanted = ranking.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    for k in (1, 10):
        got = index.topk(wanted, k, Folder(spark, "test", free=True).keep)
        shown = lambda df: sorted(map(str, df.select("query_id", "rank", "key", "score").collect()))
        assert shown(got) == shown(ranking.topk(full.scores(wanted), k))


def test_an_index_without_postings(spark):
    folder = Folder(spark, "test")
    full = ranking.LexicalIndex.of_texts(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), keep=folder.keep)
    index = impacts.ImpactIndex.build(full, f"{folder.root}/impacts")
    wanted = ranking.query_terms(spark.createDataFrame([(1, "w0")], "query_id long, query string"))
    assert index.topk(wanted, 3, Folder(spark, "test").keep).collect() == []
