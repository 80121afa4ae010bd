"""Nearest vectors in blocks of both sides against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from passagelake.operators import dense, ranking
from passagelake.sources.shared import Folder


def brute(v, q, k):
    out = []
    for i, x in q:
        found = []
        for key, y in v:
            if y is None or len(y) != len(x) or not np.isfinite(y).all() or not np.isfinite(x).all():
                continue
            n = np.linalg.norm(x) * np.linalg.norm(y)
            s = round(float(np.dot(x, y) / n), 9) if n else 0.0
            found += [(-s, key)] if s > 0 else []
        out += [(i, key, -s, r + 1) for r, (s, key) in enumerate(sorted(found)[:k])]
    return sorted((i, key, round(s, 7), r) for i, key, s, r in out)


@pytest.mark.parametrize(("vectors", "queries", "k"), [(8192, 1024, 5), (40, 7, 3), (100, 1000, 30)])
def test_nearest(spark, monkeypatch, vectors, queries, k):
    monkeypatch.setattr(dense, "VECTORS", vectors)
    monkeypatch.setattr(dense, "QUERIES", queries)
    rng = np.random.Generator(np.random.PCG64(1))
    centers = rng.normal(0, 1, (5, 8))
    v = [(k, (centers[k % 5] + rng.normal(0, 0.3, 8)).tolist()) for k in range(600)]
    v += [(600 + k, v[1][1]) for k in range(40)] + [(700, [0.0] * 8), (701, None), (702, [float("nan")] + [1.0] * 7), (703, [1.0, 2.0, 3.0])]
    q = [(k, (centers[k % 5] + rng.normal(0, 0.3, 8)).tolist()) for k in range(60)] + [(70, v[1][1]), (71, [0.0] * 8), (72, [1.0, 1.0, 1.0]), (73, [float("inf")] * 8), (74, [1.0])]
    dv = spark.createDataFrame(v, "key long, embedding array<double>").repartition(3)
    dq = spark.createDataFrame(q, "query_id long, query_vector array<double>").repartition(4)
    folder = Folder(spark, "test")
    got = dense.nearest(dv, dq, k, folder.keep)
    want = brute(v, q, k)
    assert sorted((r.query_id, r.key, round(r.score, 7), r["rank"]) for r in got.collect()) == want
    plans = sum(spark.read.parquet(f"{folder.root}/8-{n}-plan").count() for n in ("first", "rest"))
    assert plans < 62 * spark.read.parquet(f"{folder.root}/8-held").select("unit").distinct().count()  # units stay unmet
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 10)  # more queries than one pass takes
    assert sorted((r.query_id, r.key, round(r.score, 7), r["rank"]) for r in ranking.cosine_topk(dv, dq, k).collect()) == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "key string, embedding array<float>")
    asked = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, query_vector array<double>")
    assert dense.nearest(none, asked, 3, Folder(spark, "test").keep).count() == 0
    one = spark.createDataFrame([("x", [2.0, 0.0]), ("y", [0.0, 1.0])], "key string, embedding array<float>")
    assert [tuple(r) for r in dense.nearest(one, asked, 3, Folder(spark, "test").keep).collect()] == [("a", "x", 1.0, 1)]


def test_a_block_passes_on_k_of_many_equal_vectors(monkeypatch):
    monkeypatch.setattr(dense, "CELLS", 64)
    monkeypatch.setattr(dense, "HELD", 20)
    left = pa.table({"query_id": [1, 2, 3], "query_vector": [[1.0, 0.0], [1.0, 1.0], [0.0, -1.0]], "theta": [0.0, 0.5, 0.0], "units": pa.array([[0, 1], [0], [0, 1]], pa.list_(pa.int32()))})
    right = pa.table({"key": list(range(99, -1, -1)), "embedding": [[1.0, 0.0]] * 90 + [[3.0, 3.0]] * 10, "unit": pa.array([0] * 90 + [1] * 10, pa.int32())})
    got = dense._met(2, 3)(left, right).to_pylist()
    assert sorted((r["query_id"], r["key"], round(r["score"], 6)) for r in got) == [(q, k, s) for q, s in ((1, 1.0), (2, 0.707107)) for k in (10, 11, 12)]
