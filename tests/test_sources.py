import pytest

from passagelake.operators.chunking import ChunkOptions
from passagelake.sources import files
from passagelake.sources.store import EmbedderMismatch, PassageStore
from passagelake.streaming import ingest

DOCS = "source string, title string, text string"


@pytest.fixture
def folder(tmp_path):
    put = {
        "a.md": "# Head\nplain text".encode(),
        "B.TXT": "﻿with a mark".encode(),
        "sub/gbk.txt": "数据库迁移说明文档".encode("gb18030"),
        "sub/wide.txt": "two bytes each".encode("utf-16"),
        "sub/pic.png": b"\x89PNG\r\n\x1a\n\0\0\0",
        "sub/empty.txt": b"",
        "secrets.txt": b"KEY=1",
        "node_modules/x.txt": b"left out",
    }
    for name, data in put.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(tmp_path / "in")


def test_read_files(spark, folder):
    got = {r["title"]: r for r in files.read_files(spark, folder).collect()}
    assert {k: r["text"] for k, r in got.items()} == {"a.md": "# Head\nplain text", "B.TXT": "with a mark", "gbk.txt": "数据库迁移说明文档", "wide.txt": "two bytes each"}
    assert got["gbk.txt"]["encoding"] == "gb18030" and got["B.TXT"]["suffix"] == ".txt" and not got["a.md"]["truncated"]
    assert {r["title"] for r in files.read_files(spark, folder, ["*.txt"]).collect()} == {"B.TXT", "gbk.txt", "wide.txt"}
    assert files.read_files(spark, folder, limit=2).count() == 2
    verdicts = [{r["name"]: r["verdict"] for r in files.list_files(spark, folder, **kw).collect()} for kw in ({}, {"exclude": ()})]
    assert [v["x.txt"] for v in verdicts] == ["excluded", "take"] and [v["secrets.txt"] for v in verdicts] == ["sensitive"] * 2


def test_store(spark, tmp_path):
    store = PassageStore(spark, str(tmp_path / "store"), ChunkOptions(size=40, overlap=0, least=0))
    assert store.version() == 0 and store.documents().count() == 0
    long = " ".join(f"Sentence number {k} is here." for k in range(6))
    rows = [("a", "A", long), ("a", "A again", long), ("b", None, ""), (None, None, None)]
    assert store.add(spark.createDataFrame(rows, DOCS)) == 1
    had = store.stats().first().asDict()
    assert {k: had[k] for k in ("n_documents", "n_sources", "n_chunks", "n_vectors", "dim", "version")} == {"n_documents": 3, "n_sources": 3, "n_chunks": 6, "n_vectors": 6, "dim": 512, "version": 1}
    assert store.add(spark.createDataFrame([("a", "A", long), ("c", "C", "Short text.")], DOCS)) == 2
    assert {r["source"]: r["n_chunks"] for r in store.sources().collect()} == {"a": 6, "b": 0, "": 0, "c": 1}
    first = store.chunks().where("ordinal = 2").first()["chunk_id"]
    assert sorted(r["ordinal"] for r in store.neighbours([first]).collect()) == [1, 2, 3]
    gone = store.documents().where("source = 'a'").first()["id"]
    assert store.delete(["unknown"]) == 0 and store.version() == 2
    assert store.delete([gone]) == 6 and store.chunks().count() == 1
    assert store.chunks(2).count() == 7  # a reader of the version before
    before = sorted(map(tuple, store.chunks().collect()))
    store.rebuild()
    assert sorted(map(tuple, store.chunks().collect())) == before
    store.clear(keep_documents=True)
    assert store.chunks().count() == 0 and store.documents().count() == 3
    with pytest.raises(RuntimeError):  # two writers on one version
        store._publish(1, store.manifest(1))
    store.set_meta("note", "x")
    assert store.get_meta("note") == "x" and store.get_meta("note", 1) is None and not store.release()
    other = PassageStore(spark, str(tmp_path / "store"), ChunkOptions(size=40, overlap=0, least=0), "hashing:64")
    other.rebuild()
    assert {len(r["embedding"]) for r in other.rows().collect()} == {64} and other.chunks().count() == 1
    with pytest.raises(EmbedderMismatch):
        store.add(spark.createDataFrame([("d", "D", "New text.")], DOCS))
    one = other.chunks().first()["chunk_id"]
    other.put_vectors(spark.createDataFrame([(one, [1.0] * 64)], "chunk_id string, embedding array<double>"))
    assert other.rows().first()["embedding"] == [1.0] * 64
    with pytest.raises(ValueError):
        other.put_vectors(spark.createDataFrame([(one, [float("nan")] * 64)], "chunk_id string, embedding array<double>"))
    assert [(r["pos"], r["chunk_id"]) for r in other.chunks_in_order([one, "no", one]).collect()] == [(0, one), (2, one)]


def test_streaming_ingest(spark, tmp_path):
    spark.createDataFrame([("a", "A", "One text."), ("b", "B", "Another text.")], DOCS).write.parquet(str(tmp_path / "in"))
    store = PassageStore(spark, str(tmp_path / "store"))
    for _ in range(2):  # nothing new the second time
        ingest.ingest(ingest.arriving(spark, str(tmp_path / "in")), store, str(tmp_path / "at")).awaitTermination(60)
    assert store.version() == 1 and store.documents().count() == 2
