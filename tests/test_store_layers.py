"""The store's layers against a model in memory: replaced vectors, deletions, statistics that merge, compaction, writers that meet."""

import os
import random

import pytest

from passagelake.operators import ranking
from passagelake.operators.chunking import ChunkOptions
from passagelake.sources.store import Conflict, PassageStore

DOCS = "source string, text string"
WORDS = "tide gate pump level alarm valve crew shift night report".split()


def made(spark, path):
    return PassageStore(spark, str(path), ChunkOptions(size=60, overlap=0, least=0), "hashing:8")


def docs(spark, names, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(n, " ".join(rng.choices(WORDS, k=rng.randint(0, 25)))) for n in names], DOCS).coalesce(1)


def lexical(index):
    return sorted(map(tuple, index.idf.select("term", "df", "idf").collect())), [tuple(r) for r in index.lengths.collect()]


def counted(store):
    return lexical(ranking.LexicalIndex.of(store.table("postings").select("term", ranking.F.col("chunk_id").alias("key"), "tf", "dl")))


def test_layers(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    store.add(docs(spark, ["a", "b", "c"]))
    store.add(docs(spark, ["d", "e"], 1))
    ids = {r["source"]: r["id"] for r in store.documents().collect()}
    passages = [r["chunk_id"] for r in store.rows().collect()]
    new = [(passages[0], [1.0] * 8), (passages[0], [2.0] * 8), (passages[1], [3.0] * 8), ("unknown", [4.0] * 8)]
    store.put_vectors(spark.createDataFrame(new, "chunk_id string, embedding array<double>"))
    part = store.manifest()["parts"][-1]
    assert part["tables"] == ["vectors"] and spark.read.parquet(f"{store.path}/parts/{part['name']}/vectors").count() == 2
    got = {r["chunk_id"]: r["embedding"] for r in store.rows().collect()}
    assert len(got) == len(passages) == store.rows().count() and got[passages[0]] == [2.0] * 8 and got[passages[1]] == [3.0] * 8
    removed = next(r["id"] for r in store.rows().collect() if r["chunk_id"] == passages[0])
    store.delete([removed])
    assert removed not in {r["id"] for t in ("documents", "chunks", "postings", "vectors") for r in store.table(t).select("id").distinct().collect()}
    # What comes back after a deletion is new: its passages, with vectors of their own.
    name = next(s for s, i in ids.items() if i == removed)
    store.add(docs(spark, ["a", "b", "c"]) if name in "abc" else docs(spark, ["d", "e"], 1))
    again = {r["chunk_id"]: r["embedding"] for r in store.rows().collect()}
    assert set(again) == set(passages) and again[passages[0]] != [2.0] * 8
    keep = {t: sorted(map(str, store.table(t).collect())) for t in ("documents", "chunks", "postings", "vectors")}
    before = lexical(store.lexical())
    assert before == counted(store)
    store.compact(1)
    assert len(store.manifest()["parts"]) == 1 and lexical(store.lexical()) == before
    assert keep == {t: sorted(map(str, store.table(t).collect())) for t in keep}
    assert store.delete([removed]) > 0 and lexical(store.lexical()) == counted(store)
    read = {f.split("/")[-2] for f in store.table("stats").inputFiles()}
    assert read == {"stats"}


def test_plans_do_not_grow_with_parts(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    sizes = []
    for k in range(4):
        store.add(docs(spark, [f"x{k}", f"y{k}"], k))
        store.delete([store.documents().where(f"source = 'y{k}'").first()["id"]])
        if k:
            sizes.append(store.chunks()._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert len(set(sizes)) == 1 and {r["source"] for r in store.documents().collect()} == {"x0", "x1", "x2", "x3"}


def test_writers_that_meet(spark, tmp_path):
    one, two = made(spark, tmp_path / "s"), made(spark, tmp_path / "s")
    one.add(docs(spark, ["a", "b"]))
    ids = {r["source"]: r["id"] for r in one.documents().collect()}
    with one.transaction():
        one.add(docs(spark, ["c"], 1))
        assert one.delete([ids["a"]]) >= 0
        assert {r["source"] for r in one.documents().collect()} == {"b", "c"}
        assert two.version() == 1 and {r["source"] for r in two.documents().collect()} == {"a", "b"}
        two.add(docs(spark, ["d"], 2))  # other documents
    assert one.version() == 3 and {r["source"] for r in two.documents().collect()} == {"b", "c", "d"}
    assert lexical(two.lexical()) == counted(two)
    with pytest.raises(Conflict), one.transaction():
        one.delete([ids["b"]])
        two.delete([ids["b"]])
    assert one.version() == 4
    with one.transaction():  # parts merged in between hold what the base had
        one.add(docs(spark, ["e"], 3))
        two.compact(1)
    assert len(one.manifest()["parts"]) == 2 and {r["source"] for r in two.documents().collect()} == {"c", "d", "e"}
    with pytest.raises(Conflict), one.transaction():
        one.add(docs(spark, ["f"], 3))
        two.clear()


def test_a_dead_writer_leaves_nothing(spark, tmp_path):
    store = made(spark, tmp_path / "s")
    store.add(docs(spark, ["a"]))
    with pytest.raises(KeyError), store.transaction():
        store.add(docs(spark, ["b"], 1))
        raise KeyError
    assert store.version() == 1 and len(os.listdir(f"{store.path}/parts")) == 2
    assert store.sweep() == 0  # it may still be at work
    claim = f"{store.path}/versions/v2.claim"
    open(claim, "w").close()
    os.utime(claim, (1, 1))
    os.utime(f"{store.path}/parts/{next(x for x in os.listdir(f'{store.path}/parts') if x not in str(store.manifest()))}", (1, 1))
    assert store.sweep() == 2 and len(os.listdir(f"{store.path}/parts")) == 1
    open(claim, "w").close()
    os.utime(claim, (1, 1))
    assert store.add(docs(spark, ["c"], 2)) == 2  # a claim that outlived its lease
