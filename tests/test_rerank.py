"""Re-ranking by a model: the attention scorer against plain loops, and through the engine."""

import numpy as np
import pytest

from passagelake.engine import Engine, SearchOptions
from passagelake.functions.text import terms
from passagelake.operators import rerank
from passagelake.operators.chunking import ChunkOptions
from passagelake.sources.store import PassageStore


def plain(query, text, dim=16, heat=12.0):
    q, p = ([rerank._word_vector(w, dim) for w in terms(t)] for t in (query, text))
    if not q or not p:
        return 0.0
    total = 0.0
    for x in q:
        w = np.exp([heat * float(x @ y) for y in p])
        total += float(x @ (np.array(p).T @ (w / w.sum())))
    return (1 + total / len(q)) / 2


TEXTS = ["gates close before the high tide", "the tide table hangs in the pump house", "", "pump", "crews change shift at night and close the gates then", "high gates high tide " * 30]


def test_attention_equals_loops():
    pairs = [(q, t) for q in ("when do gates close", "tide", "", "the of") for t in TEXTS]
    got = rerank.attention_scores(pairs, 16)
    assert np.allclose(got, [plain(q, t) for q, t in pairs], atol=1e-9) and len(rerank.attention_scores([], 16)) == 0


def test_engine_ranks_by_model(spark, tmp_path):
    store = PassageStore(spark, str(tmp_path / "s"), ChunkOptions(size=2000, overlap=0, least=0), "hashing:8")
    store.add(spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(TEXTS)], "source string, text string"))
    engine = Engine(store, SearchOptions(rerank="attention:16"))
    asked = spark.createDataFrame([(1, "when do the gates close"), (2, "tide"), (3, " ")], "query_id long, query string")
    got = engine.search(asked, 5, "lexical").collect()
    texts = {r["source"]: r["text"] for r in store.chunks().collect()}
    for i, q in ((1, "when do the gates close"), (2, "tide")):
        mine = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
        assert mine and [r["source"] for r in mine] == sorted((r["source"] for r in mine), key=lambda s: -plain(q, texts[s]))
        assert all(abs(r["contributions"]["rerank:attention:16"] - plain(q, r["text"])) < 1e-6 for r in mine)
    built = Engine(store, SearchOptions(rerank="length:x", rerankers={"length": lambda _: lambda: lambda pairs: np.array([1.0 + len(t) for _, t in pairs])}))
    lengths = [len(r["text"]) for r in sorted(built.search("tide gates", 5, "lexical").collect(), key=lambda r: r["rank"])]
    assert lengths == sorted(lengths, reverse=True)
    with pytest.raises(ValueError):
        engine.configure(rerank="unknown")
    assert engine.options.rerank == "attention:16"
    bad = Engine(store, SearchOptions(rerank="bad", rerankers={"bad": lambda _: lambda: lambda pairs: [float("nan")] * len(pairs)}))
    with pytest.raises(Exception, match="finite scores"):
        bad.search("tide", 3, "lexical").collect()


def test_module_helpers(spark, tmp_path):
    import passagelake

    store = PassageStore(spark, str(tmp_path / "s"), embedder="hashing:8")
    store.add(spark.createDataFrame([("d", "Gates close two hours before the high tide comes in.")], "source string, text string"))
    assert [r["source"] for r in passagelake.search("gates", store=store.path, spark=spark, mode="lexical").collect()] == ["d"]
    assert "Gates close" in passagelake.ask("When do gates close?", store=store.path, spark=spark).answer
