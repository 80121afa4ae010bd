"""The folder source on a tree of odd files."""

import os

import pytest

from passagelake.sources import folder
from passagelake.sources.store import PassageStore


@pytest.fixture
def tree(tmp_path):
    put = {
        "a.md": b"# Head\ntext", ".hidden.txt": b"hidden", "_draft.md": b"draft", "empty.txt": b"", "noext": b"plain",
        "pic.png": b"\x89PNG\0", "nul.txt": b"a\0b", "gbk.txt": "数据库迁移说明文档".encode("gb18030"), "wide.txt": "two bytes".encode("utf-16"),
        "cut.txt": b"x" * 8191 + "é".encode(), "config.env": b"KEY=1", "B.TXT": "﻿mark".encode(),
        "sub/deep/c.py": b"print()", "node_modules/x.txt": b"no", "my_cache/y.txt": b"no", "sub/denied.txt": b"closed",
    }
    for name, data in put.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.symlink("a.md", tmp_path / "in" / "link.md")
    os.mkfifo(tmp_path / "in" / "pipe.txt")
    return str(tmp_path / "in")


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_every_file_is_a_row(spark, tree):
    got = by_name(folder.text_folder(spark, tree))
    assert {n: r["verdict"] for n, r in got.items() if r["verdict"] != "take"} == {"pic.png": "no text suffix", "config.env": "sensitive", "link.md": "link", "pipe.txt": "not regular"}
    texts = {n: r["text"] for n, r in got.items() if r["text"] is not None}
    assert texts == {"a.md": "# Head\ntext", ".hidden.txt": "hidden", "_draft.md": "draft", "empty.txt": "", "noext": "plain", "gbk.txt": "数据库迁移说明文档", "wide.txt": "two bytes", "cut.txt": "x" * 8191 + "é", "B.TXT": "mark", "c.py": "print()", "denied.txt": "closed"}
    assert got["nul.txt"]["error"] == "binary" and "x.txt" not in got and "y.txt" not in got
    all_ = by_name(folder.text_folder(spark, tree, exclude=()))
    assert all_["x.txt"]["text"] == "no"
    with pytest.raises(Exception, match="no such folder"):
        folder.text_folder(spark, tree + "/nowhere").collect()
    assert [r["text"] for r in folder.text_folder(spark, f"file://{tree}/a.md").collect()] == ["# Head\ntext"]


def test_names_are_pushed_to_the_listing(spark, tree, tmp_path):
    rows = folder.text_folder(spark, tree, contents=True)
    assert [r["name"] for r in rows.where("name like '%.py'").select("name", "text").collect()] == ["c.py"]
    assert {r["name"] for r in rows.where("suffix = '.txt' and name like 'e%'").collect()} == {"empty.txt"}
    reader = folder.FolderReader({"path": tree})
    left = list(reader.pushFilters([folder.StringStartsWith(("name",), "a"), folder.EqualTo(("size",), 3)]))
    assert len(left) == 1 and [f.name for p in reader.partitions() for f in p.files] == ["a.md"]
    listed = folder.text_folder(spark, tree, ["*.TXT"], contents=False, max_files=2).where("verdict in ('take', 'beyond max_files')").orderBy("path").collect()
    assert [(r["name"], r["verdict"], r["text"]) for r in listed][:3] == [(".hidden.txt", "take", None), ("B.TXT", "take", None), ("cut.txt", "beyond max_files", None)]


def test_errors_are_rows_and_documents_reach_a_store(spark, tree, tmp_path):
    found = folder.Found(f"{tree}/gone.txt", "gone.txt", ".txt", 1, "take")
    assert "FileNotFoundError" in folder.read_one(tree, found, False)[-1]
    docs = folder.folder_documents(folder.text_folder(spark, tree, ["*.md", "*.py"]))
    store = PassageStore(spark, str(tmp_path / "store"), embedder="hashing:8")
    store.add(docs)
    assert {r["title"]: r["mime_type"] for r in store.documents().collect()} == {"a.md": "text/markdown", "_draft.md": "text/markdown", "c.py": "text/x-python"}


def test_lenient_decoders_vote():
    assert not folder.binary("é".encode(), True) and not folder.binary("abcé".encode()[:-1], False) and folder.binary(b"abc\xe9", True)
    assert folder.binary(b"\x81\xff\0", True) and not folder.binary(b"", True)
