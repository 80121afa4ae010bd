"""Pruned lexical top-k against the full scan, and the stored index of a folder that changes."""

import random

import pytest

from passagelake.operators import impacts, ranking
from passagelake.plans import catalog
from passagelake.sources.shared import Folder


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    weight = [1 / (k + 1) for k in range(120)]
    rows = [(k, " ".join(rng.choices(words, weight, k=rng.randint(0, 40)))) for k in range(900)]
    rows += [(900 + k, rows[3][1]) for k in range(30)] + [(990, None), (991, "")]  # ties, none
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("head", "k"), [(4, 3), (1, 10), (1000, 5)])
def test_topk_equals_full_scan(spark, corpus, monkeypatch, head, k):
    for name, value in (("HEAD", head), ("CLASSES", 8), ("BUCKETS", 3), ("SHELF", 64)):
        monkeypatch.setattr(impacts, name, value)
    folder = Folder(spark, "test")
    full = ranking.LexicalIndex.of(ranking.postings_of(ranking.document_terms(corpus)), keep=folder.keep)
    index = impacts.ImpactIndex.build(full, f"{folder.root}/impacts")
    asked = [(1, "w0 w1 w2 w3"), (2, "w7"), (3, "w119 w90 w1"), (4, "unknown"), (5, ""), (6, "w5 w5 w60 unknown w0"), (7, " ".join(f"w{k}" for k in range(40)))]
    wanted = ranking.query_terms(spark.createDataFrame(asked, "query_id long, query string"))
    opened = []
    monkeypatch.setattr(impacts.ImpactIndex, "_opened", lambda self, parts, real=impacts.ImpactIndex._opened: opened.append(parts) or real(self, parts))
    got = sorted(map(tuple, index.topk(wanted, k, Folder(spark, "test").keep).select("query_id", "rank", "key", "score").collect()))
    assert got == sorted(map(tuple, ranking.topk(full.scores(wanted), k).select("query_id", "rank", "key", "score").collect()))
    # A query of one rare word opens one folder.
    opened.clear()
    index.topk(wanted.where("query_id = 2"), 1, Folder(spark, "test").keep).collect()
    assert [len(x) for x in opened] in ([1, 0], [1, 1], [1, 2])
    assert head < 1000 or index.blocks.where("tier > 0").count() == 0


def test_index_of_a_folder_follows_its_documents(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    for rows in ([(1, "alpha")], [(2, "beta"), (3, "alpha beta")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(at)
        got = {tuple(r) for r in catalog.term_frequencies(spark, str(tmp_path)).collect()}
        assert got == {(i, t, 1) for i, text in rows for t in text.split()}
