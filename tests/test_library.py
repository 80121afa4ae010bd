import math

import pytest
from pyspark.sql import functions as F

from passagelake.functions import text as tx
from passagelake.functions import vectors as vec
from passagelake.operators import chunking, conversation, embedding, ranking
from passagelake.plans import catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms_by_expression_and_python_agree(spark):
    texts = ["The Café isn't a_b-c far!", "Straße 7 x", "", None, "ÀÉÎõü naïve", "full-width ＡＢＣ and 中文字 mixed"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: (r.a, r.b) for r in rows.select("k", tx.words(F.col("t")).alias("a"), tx.any_words(F.col("t")).alias("b")).collect()}
    for k, t in enumerate(texts):
        assert got[k][1] == tx.terms(t)
        if k < 5:
            assert got[k][0] == tx.terms(t)
    assert tx.terms("中文字") == ["中", "文", "字", "中文", "文字"]


def test_idf_floor_and_ties(spark):
    docs = spark.createDataFrame([(k, "common rare" if k == 0 else "common other") for k in range(3)], "doc_id long, text string")
    idf = {r.term: r.idf for r in ranking.inverse_frequencies(ranking.document_terms(docs)).collect()}
    raw = {t: math.log((3 - n + 0.5) / (n + 0.5)) for t, n in (("common", 3), ("rare", 1), ("other", 2))}
    floor = 0.25 * sum(raw.values()) / 3
    assert idf["rare"] == pytest.approx(raw["rare"])
    assert idf["common"] == pytest.approx(floor if floor > 0 else 0.25)
    asked = spark.createDataFrame([(1, "other other")], "query_id long, query string")
    top = ranking.topk(ranking.bm25(docs, asked), 5).orderBy("rank").collect()
    assert [r["key"] for r in top] == [1, 2] and top[0].score == top[1].score


def test_fusion_weights_and_values(spark):
    rows = [(1, "a", 1, 10, 4.0), (1, "a", 2, 11, 2.0), (1, "b", 1, 11, 0.5), (2, "a", 1, 10, 3.0)]
    ranked = spark.createDataFrame(rows, "query_id long, list string, rank long, key long, score double")
    rrf = {(r.query_id, r.key): r.score for r in ranking.fused(ranked, {"a": 0.7, "b": 0.3}).collect()}
    assert rrf[1, 10] == pytest.approx(0.7) and rrf[1, 11] == pytest.approx(0.7 * 61 / 62 + 0.3) and rrf[2, 10] == pytest.approx(1.0)
    dbsf = {(r.query_id, r.key): r.score for r in ranking.fused(ranked, {"a": 0.7, "b": 0.3}, "dbsf").collect()}
    assert dbsf[1, 10] == pytest.approx(0.7) and dbsf[1, 11] == pytest.approx(0.3) and dbsf[2, 10] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ranking.fused(ranked, {"a": 1.0}, "other")


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(k, f"alpha beta w{k % 7} w{k % 3}") for k in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha w1 w2"), (2, "beta w6")], "query_id long, query string")
    seen = set()
    for n in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(map(tuple, ranking.topk(ranking.bm25(docs.repartition(n), asked), 7).orderBy("query_id", "rank").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vec.normalised(v)) == [0.6, 0.8]
    assert one(spark, vec.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vec.cosine(v, F.array(F.lit(4.0), F.lit(-3.0)))) == 0
    assert not one(spark, vec.finite(F.array(F.lit(1.0), F.lit(float("nan")))))


def test_hashed_embedding_is_unit_and_salted():
    e = embedding.embed(["alpha", "beta", "alpha"])
    assert abs(float((e * e).sum()) - 1) < 1e-5 and (e != 0).sum() >= 3
    assert not embedding.embed([]).any()
    with pytest.raises(ValueError):
        embedding.embed(["a"], dim=0)


def test_chunks_keep_all_text_and_fences(spark):
    body = "# Title\n" + " ".join(f"Sentence number {k} ends here." for k in range(120)) + "\n```py\n" + "x = 1\n" * 300 + "```\ntail"
    parts = chunking.chunk_text(body)
    kept = "".join("".join(p.split()) for p in parts)
    assert all("".join(w.split()) in kept for w in body.split())
    assert any(p.startswith("```") and len(p) > 1000 for p in parts)
    assert chunking.chunk_text("  \n") == [] and chunking.chunk_text(None) == []
    assert chunking.chunk_text("x" * 1000 + "y" * 1000)[1][:200] == "x" * 200
    docs = spark.createDataFrame([(1, "s", body), (2, "s", None)], "doc_id long, source string, text string")
    rows = chunking.chunks(docs).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.ordinal)] == parts and len({r.chunk_id for r in rows}) == len(parts)


def test_compaction_keeps_the_newest(spark):
    rows = [(1, k, "user", "x" * 400) for k in range(5)] + [(2, 0, "user", "y" * 4000)]
    kept = conversation.compaction_tail(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 300).collect()
    assert sorted((r.conv_id, r.turn) for r in kept) == [(1, 3), (1, 4), (2, 0)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query_id long, key long, rank long")
    good = spark.createDataFrame([(1, 6), (1, 9), (2, 1)], "query_id long, key long")
    m = {r.query_id: r for r in ranking.retrieval_metrics(ranked, good, 2).collect()}
    assert (m[1].recall, m[1].precision, m[1].reciprocal_rank, m[1].hit) == (0.5, 0.5, 0.5, 1.0)
    assert (m[2].recall, m[2].reciprocal_rank, m[2].hit) == (0.0, 0.0, 0.0)


def test_metrics_of_groups_equal_those_of_pairs(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (3, 5, 3), (4, 5, 1)], "query_id long, key long, rank long")
    good = spark.createDataFrame([(0, 5), (0, 5), (0, 8), (1, 7)], "group long, key long")
    groups = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 0), (4, 2), (5, 0)], "query_id long, group long")
    got = ranking.retrieval_metrics(ranked, good, 2, groups).collect()
    assert sorted(got) == sorted(ranking.retrieval_metrics(ranked, groups.join(good, "group"), 2).collect()) and {r[0] for r in got} == {1, 2, 3, 5}


def test_evaluation_takes_every_good_document_of_a_remainder(spark, tmp_path):
    spark.createDataFrame([(k, f"word{k}", "s") for k in range(20)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "word10 word15"), (6, "word11")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["query_id"]: (r["recall"], r["reciprocal_rank"]) for r in catalog.eval_metrics(spark, str(tmp_path)).collect()}
    assert got == {0: (0.5, 1.0), 6: (0.25, 1.0)}  # of four documents each, 0 5 10 15 and 1 6 11 16


def test_texts_are_judged_once_and_cut_alike(spark):
    texts = ["Plain 'quoted-word' a 7 b_c-", "Größe ÀÉ straße", "数据库 x1", "ﬁne mixed İstanbul", None, "", "ß" * 50 + " end" + "-" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.any_words(F.col("t")).alias("w"), "t").collect()
    assert all(r["w"] == tx.terms(r["t"]) for r in got)
    long = ranking.postings_of(ranking.document_terms(spark.createDataFrame([(1, "a")], "doc_id long, text string")))
    assert long._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # no second cut for a pushed filter


def test_scores_add_up_in_any_order(spark):
    rows = [(1, k, 0.1 * k + 1e-7) for k in range(200)]
    one = [spark.createDataFrame(sorted(rows, key=lambda r: f(r[1])), "q long, k long, part double").repartition(n).groupBy("q").agg(F.sum(F.rint(F.col("part") * ranking.SCALE).cast("long")).alias("s"), ranking.total(F.col("part")).alias("t")).first() for f, n in ((abs, 1), (lambda x: -x, 7))]
    assert one[0] == one[1] and abs(one[0]["t"] - sum(r[2] for r in rows)) < 1e-8


def test_texts_are_embedded_in_bounded_runs(spark):
    def few(texts):
        assert sum(map(len, texts)) <= 1 << 20
        return [[float(len(t))] for t in texts]

    rows = [(k, "x" * n) for k, n in enumerate([600_000, 600_000, 0, 1 << 20, 5])] + [(5, None)]
    got = embedding.hashed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), embedder=few).collect()
    assert {r["doc_id"]: r["embedding"] for r in got} == {k: [float(len(t or ""))] for k, t in rows}


def test_words_are_counted_before_they_are_rows(spark, monkeypatch):
    """F7, F9, F11, F15-F21, F23: no row for each word of the corpus; lots, repeated keys and documents without words."""
    from collections import Counter

    from pyspark import cloudpickle

    monkeypatch.setattr(ranking, "COUNTED", 7)
    cloudpickle.register_pickle_by_value(ranking)
    try:
        rows = [(k, " ".join(f"w{(k * j) % 5}" for j in range(k % 11))) for k in range(60)] + [(7, "w1 other"), (61, None), (None, "w1 w1 w2")]
        terms = ranking.document_terms(spark.createDataFrame(rows, "doc_id long, text string"))
        found = ranking.postings_of(terms)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, map(tuple, found.select("key", "term", "tf", "dl").collect())))
    finally:
        cloudpickle.unregister_pickle_by_value(ranking)
    whole: dict = {}
    for k, t in rows:
        whole.setdefault(k, []).extend((t or "").split())
    size = {k: len(t) for k, t in whole.items()}
    assert {x for x in got if x.startswith("(7,")} and len([x for x in got if x.startswith("(7,")]) == len(Counter(whole[7]))
    want = [(k, w, n, size[k]) for k, t in whole.items() if k != 7 for w, n in Counter(t or [""]).items()]
    assert [x for x in got if not x.startswith("(7,")] == sorted(map(str, [(k, w, n if size[k] else 1, d) for k, w, n, d in want]))
