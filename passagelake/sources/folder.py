"""A folder of text files as a Spark data source, ``textfolder``: every file is a row, read or not, with the reason.

Names are judged while the folder is listed, hidden and empty files included; a partition is some files of similar size together, and a task
opens only those taken.  Filters on ``name``, ``path``, ``suffix`` and ``verdict`` of listed files are applied to the listing, so files that they leave
out are never opened.  A file that cannot be read, or holds no text, is a row with its ``error``, not a failure.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from pathlib import PurePosixPath

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..functions.text import SENSITIVE_ENDS, SENSITIVE_NAMES, SENSITIVE_STARTS, content_id, mime_type
from .files import DEFAULT_EXCLUDE, HEAD, MOST, decode

# Suffixes of files that hold text (fixed values); files without a suffix are taken too.
TEXT_SUFFIXES = [
    ".txt", ".md", ".markdown", ".rst", ".adoc", ".org", ".tex",
    ".py", ".pyi", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".json", ".jsonl",
    ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env",
    ".go", ".rs", ".java", ".kt", ".scala", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".rb", ".php",
    ".sh", ".bash", ".zsh", ".fish", ".sql",
    ".html", ".htm", ".xml", ".css", ".scss", ".less", ".svg", ".vue", ".svelte",
    ".csv", ".tsv", ".log", ".diff", ".patch",
]
MAX_FILES = 20_000
#: Files and bytes of a partition, whichever comes first.
PART_FILES, PART_BYTES = 256, 64 << 20
SCHEMA = "path string, name string, suffix string, size long, verdict string, text string, encoding string, truncated boolean, error string"


@dataclass(frozen=True)
class Found:
    path: str
    name: str
    suffix: str
    size: int
    verdict: str


class Files(InputPartition):
    def __init__(self, files: list[Found]):
        self.files = files


def _covered(name: str, globs: Sequence[str]) -> bool:
    return any(g in ("", "*") or fnmatch(name, g) or fnmatch(name.lower(), g.lower()) for g in globs)


def _sensitive(name: str) -> bool:
    n = name.lower()
    return n in SENSITIVE_NAMES or ".env" in n or n.startswith(tuple(SENSITIVE_STARTS)) or n.endswith(tuple(SENSITIVE_ENDS))


def _entries(place: pafs.FileSystem | None, folder: str) -> tuple[list[str], list[tuple[str, int, str]]]:
    """Folders and (name, size, kind) of files in one folder, both by name; kind is ``file``, ``link`` or ``other``."""
    if place is not None:
        got = place.get_file_info(pafs.FileSelector(folder))
        return sorted(x.base_name for x in got if x.type == pafs.FileType.Directory), sorted((x.base_name, x.size or 0, "file") for x in got if x.type == pafs.FileType.File)
    with os.scandir(folder) as it:
        all_ = sorted(it, key=lambda e: e.name)
    kind = lambda e: "link" if e.is_symlink() else "file" if e.is_file() else "other"
    return [e.name for e in all_ if e.is_dir(follow_symlinks=False)], [(e.name, e.stat(follow_symlinks=False).st_size, kind(e)) for e in all_ if e.is_symlink() or not e.is_dir(follow_symlinks=False)]


def verdict(name: str, kind: str, patterns: Sequence[str], exclude: Sequence[str]) -> str:
    """``take``, or why a file is left out by its name and kind."""
    if name in exclude:
        return "excluded"
    if _sensitive(name):
        return "sensitive"
    if not _covered(name, patterns or ["*"]):
        return "unmatched"
    if PurePosixPath(name).suffix and PurePosixPath(name).suffix.lower() not in TEXT_SUFFIXES:
        return "no text suffix"
    return {"link": "link", "other": "not regular"}.get(kind, "take")


def walk(root: str, patterns: Sequence[str], exclude: Sequence[str], max_files: int) -> Iterator[Found]:
    """Every file below ``root`` in order of folders and names; no more are taken after ``max_files``.  Excluded folders are not entered."""
    place, top = _opened(root)
    if place is None and os.path.isfile(top) or place is not None and place.get_file_info(top).type == pafs.FileType.File:
        size = os.path.getsize(top) if place is None else place.get_file_info(top).size or 0
        yield Found(top, top.rpartition("/")[2], PurePosixPath(top).suffix.lower(), size, "take")
        return
    if place is None and not os.path.isdir(top) or place is not None and place.get_file_info(top).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no such folder: {root}")
    todo, taken = [top.rstrip("/")], 0
    while todo:
        here = todo.pop()
        folders, files = _entries(place, here)
        for name, size, kind in files:
            judged = verdict(name, kind, patterns, exclude)
            taken += judged == "take"
            yield Found(f"{here}/{name}", name, PurePosixPath(name).suffix.lower(), size, "beyond max_files" if judged == "take" and taken > max_files else judged)
        todo += [f"{here}/{d}" for d in reversed(folders) if not any(d == g or fnmatch(d, g) for g in exclude)]


def _opened(path: str) -> tuple[pafs.FileSystem | None, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    place, inside = pafs.FileSystem.from_uri(path)
    return place, inside


def binary(head: bytes, whole: bool) -> bool:
    """A NUL byte, or no UTF-8 and yet something that two of three lenient encodings take; a character cut at the end does not count."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    if b"\0" in head:
        return True
    try:
        head.decode("utf-8")
        return False
    except UnicodeDecodeError as e:
        if not whole and e.start >= len(head) - 3 and e.reason == "unexpected end of data":
            return False

    def takes(name: str) -> bool:
        try:
            return bool(head.decode(name)) or True
        except UnicodeDecodeError:
            return False

    return sum(map(takes, ("latin-1", "utf-16", "cp1252"))) >= 2


def read_one(root: str, f: Found, vote: bool) -> tuple:
    """A row of ``SCHEMA`` for one file."""
    text = encoding = error = None
    if f.verdict == "take":
        try:
            place, _ = _opened(root)
            if place is None:
                if not stat.S_ISREG(os.stat(f.path).st_mode):
                    raise OSError("not a regular file")
                with open(f.path, "rb") as file:
                    raw = file.read(MOST)
            else:
                with place.open_input_stream(f.path) as file:
                    raw = file.read(MOST)
            head = raw[:HEAD]
            if binary(head, len(raw) <= HEAD) if vote else b"\0" in head and head[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                error = "binary"
            else:
                text, encoding = decode(raw)
        except OSError as e:
            error = f"{type(e).__name__}: {e.strerror or e}"
    return f.path, f.name, f.suffix, f.size, f.verdict, text, encoding, f.size > MOST, error


class FolderReader(DataSourceReader):
    _FIELDS = ("path", "name", "suffix", "verdict")

    def __init__(self, options: dict):
        self.root, self.contents, self.vote = options["path"], options.get("contents", "true") == "true", options.get("vote", "false") == "true"
        self.patterns, self.exclude = json.loads(options.get("patterns", "[]")), json.loads(options.get("exclude", json.dumps(DEFAULT_EXCLUDE)))
        self.max_files, self.tests = int(options.get("max_files", MAX_FILES)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        ways = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
        for f in filters:
            if type(f) in ways and len(f.attribute) == 1 and f.attribute[0] in self._FIELDS:
                self.tests.append((f.attribute[0], ways[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        parts, now, size = [], [], 0
        for f in walk(self.root, self.patterns, self.exclude, self.max_files):
            if not all(test(getattr(f, name), value) for name, test, value in self.tests):
                continue
            now.append(f)
            size += min(f.size, MOST)
            if len(now) >= PART_FILES or size >= PART_BYTES:
                parts.append(Files(now))
                now, size = [], 0
        return [*parts, Files(now)] if now or not parts else parts

    def read(self, partition: Files) -> Iterator[tuple]:
        for f in partition.files:
            yield read_one(self.root, f, self.vote) if self.contents else (f.path, f.name, f.suffix, f.size, f.verdict, None, None, f.size > MOST, None)


class TextFolder(DataSource):
    """``spark.read.format("textfolder")``: options ``path``; ``patterns`` and ``exclude`` (JSON lists of globs), ``max_files``,
    ``contents`` (``false`` lists only) and ``vote`` (``true``: lenient decoders tell binary files, besides NUL bytes)."""

    @classmethod
    def name(cls) -> str:
        return "textfolder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def text_folder(spark: SparkSession, root: str, patterns: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDE, max_files: int = MAX_FILES, contents: bool = True, vote: bool = False) -> DataFrame:
    """The rows of ``SCHEMA`` for every file below ``root``; an explicit ``exclude`` replaces the default, an empty one as well."""
    spark.dataSource.register(TextFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"patterns": json.dumps(list(patterns)), "exclude": json.dumps(list(exclude)), "max_files": str(max_files), "contents": str(contents).lower(), "vote": str(vote).lower()}
    return spark.read.format("textfolder").options(**options).load(root)


def folder_documents(rows: DataFrame) -> DataFrame:
    """Documents (source, title, text, mime_type, metadata, id) of the files that could be read."""
    about = F.create_map(F.lit("path"), "path", F.lit("name"), "name", F.lit("suffix"), "suffix", F.lit("size"), F.col("size").cast("string"), F.lit("encoding"), "encoding")
    good = rows.where("verdict = 'take' and error is null")
    return good.select(content_id(F.col("path"), F.col("text")).alias("id"), F.col("path").alias("source"), F.col("name").alias("title"), "text", mime_type(F.col("suffix")).alias("mime_type"), about.alias("metadata"))
