"""F1, F3 of round 4: a store's postings in blocks, texts cut and embedded where they are read, and searches summed up where passages lie."""

import hashlib
import random
from itertools import pairwise

import numpy as np
import pytest

from passagelake.engine import Engine
from passagelake.functions import text as tx
from passagelake.operators import blocks, embedding, ranking
from passagelake.operators.chunking import ChunkOptions
from passagelake.sources.store import PassageStore

WORDS = [f"w{k}" for k in range(60)]


def docs(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(f"s{seed}-{k}", "!!! ... ???" if k % 9 == 4 else "\n\n".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 6)))) for k in range(n)]
    return spark.createDataFrame(rows, "source string, text string").repartition(2)


@pytest.fixture
def store(spark, tmp_path):
    return PassageStore(spark, f"{tmp_path}/s", ChunkOptions(size=40, overlap=0, least=0), "hashing:8")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_those_of_each_word(monkeypatch):
    """words are cut and counted together, and the vectors are as when each word was taken by itself."""
    rng = random.Random(4)
    texts = ["", "x", "a b", "Straße naïve", "数据 mixed ＡＢＣ w1 w2", "w1 w2 w1 w2"] + [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(50)]
    slot = lambda f, salt: int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8, salt=salt).digest(), "little") % 32
    want = np.zeros((len(texts), 32))
    for k, words in enumerate(map(tx.terms, texts)):
        for w in words:
            want[k, slot(w, b"")] += 1
        for a, b in pairwise(words):
            want[k, slot(f"{a}\x1f{b}", b"\x01")] += 0.5
    want = np.where(want > 0, 1 + np.log(np.where(want > 0, want, 1)), 0)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    by_words = embedding.embed_many([tx.terms(t) for t in texts], 32)
    judged = []
    monkeypatch.setattr(tx, "terms", lambda t, real=tx.terms: judged.append(t) or real(t))
    got = embedding.hashing_embedder(32)(texts)
    assert np.allclose(got, want, atol=1e-6) and (got == by_words).all()
    assert judged == [texts[4]]  # only what is not Latin goes word by word


def test_texts_are_cut_and_embedded_where_they_are_read(spark, store, monkeypatch):
    """of a part only its documents are dealt by id; passages, words and vectors are made where these lie, and postings are no rows."""
    plans = {}
    real = PassageStore._put
    monkeypatch.setattr(PassageStore, "_put", lambda self, df, path: plans.update({path.rpartition("/")[2]: plan(df)}) or real(self, df, path))
    store.add(docs(spark, 40))
    assert [t for t in ("chunks", "blocks", "vectors") if "Exchange" in plans[t]] == [] and "postings" not in plans


@pytest.mark.parametrize("few", [1, 1000])
def test_deletions_in_blocks(spark, store, few, monkeypatch):
    """passages leave their blocks and the statistics; those without words count too."""
    monkeypatch.setattr(blocks, "DOCUMENTS", 7)
    store.add(docs(spark, 60))
    store.add(docs(spark, 40, 1))
    rows = lambda: sorted(map(tuple, store.table("postings").select("chunk_id", "term", "tf", "dl").collect()))
    before, ids = rows(), [r["id"] for r in store.documents().sort("id").collect()]
    gone = ids[:few] if few == 1 else ids[::2]
    lost = {r["chunk_id"] for r in store.chunks().collect() if r["id"] in gone}
    store.delete(gone)
    assert rows() == [r for r in before if r[0] not in lost] and any(r[1] == "" and r[3] == 0 for r in before)
    left = store.table("postings").select("term", ranking.F.col("chunk_id").alias("key"), "tf", "dl")
    counted, kept = ranking.LexicalIndex.of(left), store.lexical()
    for a, b in ((counted.idf, kept.idf), (counted.lengths, kept.lengths)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for n, seed in ((60, 0), (40, 1)):
        store.add(docs(spark, n, seed))
    assert rows() == before  # what comes back
    columns = ["id", ranking.F.length("text").alias("n")]
    assert sorted(map(tuple, store.documents(columns=columns).collect())) == sorted(map(tuple, store.documents().select(*columns).collect()))


def test_search_shuffles_only_what_may_be_best(spark, store, monkeypatch):
    """pairs of query and passage are summed up where the passage lies and cut to the pool there; no row of all pairs is shuffled."""
    store.add(docs(spark, 300))
    asked = spark.createDataFrame([(k, f"w{k} w{k + 1} w{k + 20}") for k in range(6)], "query_id long, query string")
    seen = []
    real = ranking.LexicalIndex.scores
    monkeypatch.setattr(ranking.LexicalIndex, "scores", lambda self, *a, **kw: seen.append(real(self, *a, **kw)) or seen[-1])
    engine = Engine(store)
    got = sorted(map(tuple, engine.search(asked, 2, "lexical").select("query_id", "rank", "chunk_id", "score").collect()))
    assert "Exchange" not in plan(seen[0])
    full = ranking.LexicalIndex.of(store.table("postings").select("term", ranking.F.col("chunk_id").alias("key"), "tf", "dl"))
    whole = real(full, ranking.query_terms(asked))
    assert seen[0].count() < whole.count() / 2
    assert got == sorted(map(tuple, ranking.topk(whole, 2).select("query_id", "rank", "key", ranking.F.round("score", 8)).collect()))
