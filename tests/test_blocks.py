"""F16-F20: postings in blocks of documents, scored where they lie, against postings as rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from passagelake.functions import text as tx
from passagelake.operators import blocks, ranking
from passagelake.plans import catalog
from passagelake.sources.shared import Folder


def test_words_are_cut_as_by_text():
    rng = random.Random(3)
    texts = ["Straße 7 x", "", None, "ÀÉÎõü naïve", "full-width ＡＢＣ and 中文字 mixed", "ﬁne İstanbul", "x́y", "Ÿ ẞ K", "q × w", "é", "--a--b'c_", "ß-ß", "“the”"]
    texts += ["".join(rng.choices("ab7 -'_ÀéßĀŸ\n中×.Z\x00", k=rng.randint(0, 30))) for _ in range(2000)]
    words, word, text = blocks.cut(pa.array(texts).slice(1))
    got = [[] for _ in texts[1:]]
    for w, t in zip(word, text, strict=True):
        got[t].append(words[int(w)].as_py())
    assert [sorted(g) for g in got] == [sorted(tx.terms(t)) for t in texts[1:]]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("TEXT", 300), ("DOCUMENTS", 7), ("CELLS", 20)):
        monkeypatch.setattr(blocks, name, value)
    cloudpickle.register_pickle_by_value(blocks)
    yield
    cloudpickle.unregister_pickle_by_value(blocks)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_blocks_score_as_rows(spark, small, monkeypatch, k):
    rng = random.Random(6)
    names = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join(rng.choices(names, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40)))) for n in range(400)]
    rows += [(400 + n, rows[3][1]) for n in range(60)] + [(-1, None), (-2, ""), (None, "w1 w1 w2"), (500, "w1 " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = ranking.LexicalIndex.of(ranking.postings_of(ranking.document_terms(docs)), keep=Folder(spark, "test").keep)
    new = ranking.LexicalIndex.of_texts(docs, keep=Folder(spark, "test").keep)
    rows_of = lambda df: sorted(map(str, map(tuple, df.collect())))
    for a, b in ((old.postings.select("term", "key", "tf", "dl"), new.postings), (old.idf, new.idf), (old.lengths, new.lengths)):
        assert rows_of(a) == rows_of(b)
    asked = [(1, "w0 w1 w2 w3"), (2, "w7"), (3, "w59 w40 w1"), (4, "unknown"), (5, ""), (7, rows[3][1])]
    wanted = ranking.query_terms(spark.createDataFrame(asked, "query_id int, query string"))
    full = old.scores(wanted)
    assert rows_of(full) == rows_of(new.scores(wanted))
    some = new.scores(wanted, best=k)
    assert "Exchange" not in some._jdf.queryExecution().executedPlan().toString()  # no pair is shuffled for its sum
    assert k > 3 or some.count() < full.count() / 2
    assert rows_of(ranking.topk(full, k)) == rows_of(ranking.topk(some, k))
    assert new.scores(wanted.where("query_id = 4"), best=k).count() == 0
    monkeypatch.setattr(ranking, "ASKED", 3)
    assert rows_of(full) == rows_of(new.scores(wanted, best=k))  # more terms than go to all blocks


def test_rows_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a1 b1"), (1, "b1 c1"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, blocks.postings(blocks.of(docs)).collect()))
    assert got == [("a1", 1, 1, 4), ("b1", 1, 2, 4), ("c1", 1, 1, 4)]


def test_answers_leave_texts_where_they_are(spark, tmp_path):
    """F16: the few texts found are picked by a broadcast of their keys; no text of the corpus is shuffled."""
    rng = random.Random(2)
    rows = [(k, " ".join(f"word{rng.randrange(5000)}" for _ in range(300)) + ". A closing sentence of some length.", "s") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, rows[k][1][:60]) for k in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 64 << 10)
    try:
        found = catalog.answer_sentences(spark, str(tmp_path))
        assert {r["query_id"] for r in found.collect()} == set(range(5))
        assert "hashpartitioning(key" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_of_unlike_keys_stay_where_they_are_read(spark):
    """texts are only brought together where a key is repeated."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(k, f"w{k % 7} w{k % 11}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16).localCheckpoint()
    assert "Exchange" not in plan(blocks.of(docs))
    words = lambda df: sorted(map(str, blocks.postings(blocks.of(df)).collect()))
    repeated = [(3, "w1 more"), (3, None), (None, "w1 w2"), (None, "w2")]
    merged = [(k, f"{t} w1 more" if k == 3 else t) for k, t in rows] + [(None, "w1 w2 w2")]
    schema = "doc_id long, text string"
    assert words(spark.createDataFrame(rows + repeated, schema)) == words(spark.createDataFrame(merged, schema))
    one = spark.createDataFrame(rows, schema).coalesce(1).localCheckpoint()  # one task has all: it is dealt out
    assert words(one) == words(docs) and "hashpartitioning(key" in plan(blocks.of(one))


def test_scores_are_rounded_as_by_spark(spark):
    """scores leave Python rounded, as Spark's ``round`` has them, halves included."""
    rng = random.Random(5)
    total = [rng.randrange(60 << 43) for _ in range(2000)] + [n << 33 for n in range(1, 3000, 2)] + [round((rng.randrange(10**10) + 0.5) / 1e9 * ranking.SCALE) + rng.randint(-1, 1) for _ in range(3000)]
    shown = spark.createDataFrame([(n, x) for n, x in enumerate(total)], "n int, total long").selectExpr("n", f"round(total / {ranking.SCALE:.0f}D, 9) AS score").sort("n")
    assert [r["score"] for r in shown.collect()] == blocks.rounded(np.array(total), ranking.SCALE, 9).tolist()


def test_weights_do_not_hang_on_the_order_of_terms(spark):
    """each count of a term is added up once, and the mean of weights is the same in whatever order they come."""
    counts = [(f"t{n}", n % 97 + 1) for n in range(3000)] + [("", 100)]
    weights = []
    for rows in (counts, counts[::-1], sorted(counts, key=lambda r: r[1] * 7919 % 101)):
        idf = ranking._weighed(spark.createDataFrame(rows, "term string, df long").coalesce(1).localCheckpoint(), 0.25)
        weights.append(sorted(map(tuple, idf.collect())))
    assert weights[0] == weights[1] == weights[2]
    docs = spark.createDataFrame([(k, f"a{k % 3} b{k}") for k in range(50)], "doc_id long, text string")
    index = ranking.LexicalIndex.of_texts(docs, keep=Folder(spark, "test").keep)
    assert "MapInArrow" not in index.idf._jdf.queryExecution().executedPlan().toString()
    assert index.blocks.schema["word"].dataType.simpleString() == "binary"  # numbers that are copied whole
