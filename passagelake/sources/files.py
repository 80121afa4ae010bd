"""Text files as documents, read by Spark from any store it can list."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id, mime_type, sensitive_name

# Encodings tried in this order (fixed values); the last one decodes anything.
ENCODINGS = ("utf-8-sig", "gb18030", "big5", "shift_jis", "cp1252", "latin-1")
#: Bytes at a file's head that tell binary files from text.
HEAD = 8192
#: Bytes of a file that are read as text; ``truncated`` marks files that have more.
MOST = 8 << 20
#: Folders and names that hold no prose: version control, caches of tools, installed or built things.
DEFAULT_EXCLUDE = (".git", ".hg", ".svn", "__pycache__", "*_cache", ".cache", ".tox", ".nox", "node_modules", "*venv", "site-packages", "dist", "build", "target", ".next", "*.egg-info")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over a whole name, without regard to case."""
    inside, k = "", 0
    while k < len(glob):
        close = glob.find("]", k + 2) if glob[k] == "[" else -1
        if close > 0:
            members = glob[k + 1 : close].replace("\\", r"\\").replace("[", r"\[")
            inside += "[" + ("^" + members[1:] if members.startswith("!") else members) + "]"
        k, inside = (close + 1, inside) if close > 0 else (k + 1, inside + {"*": ".*", "?": "."}.get(glob[k], re.escape(glob[k])))
    return f"(?is)^{inside}$"


def matches_any(name: Column, globs: Sequence[str]) -> Column:
    """Names that one of the globs covers; no globs cover all."""
    found = F.lit(not globs)
    for g in globs:
        found = found | name.rlike(glob_pattern(g))
    return found


def looks_binary(content: Column) -> Column:
    """A NUL byte in the head of the file, without the byte-order mark of a two-byte encoding."""
    head = F.substring(content, 1, HEAD)
    mark = F.hex(F.substring(content, 1, 2))
    return ~mark.isin("FFFE", "FEFF") & (F.instr(F.decode(head, "ISO-8859-1"), "\0") > 0)


def decode(content: bytes) -> tuple[str, str]:
    """The text and the encoding that fits it first; UTF-16 goes by its byte-order mark."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content[: len(content) // 2 * 2].decode("utf-16", "replace"), "utf-16"
    for name in ENCODINGS:
        try:
            return content.decode(name), name
        except UnicodeDecodeError as e:
            # A cut at MOST bytes may split the last character.
            if name == "utf-8-sig" and len(content) == MOST and e.start >= MOST - 4:
                return content[: e.start].decode(name), name
    raise AssertionError("latin-1 decodes all bytes")


def list_files(spark: SparkSession, root: str, patterns: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDE) -> DataFrame:
    """``path, name, size, verdict`` of every file below ``root``, contents unread.

    ``verdict`` is ``take``, or why a file is left out: ``excluded`` (a folder or
    name that ``exclude`` covers), ``sensitive`` (names of credentials) or
    ``unmatched``.  An explicit ``exclude`` replaces the default.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Only names below the root count: what is above it is the caller's choice.
    parts = F.split(F.regexp_replace("path", r"^\w+:/*", ""), "/")
    above = len(re.sub(r"^\w+:/*", "", root).strip("/").split("/"))
    below = F.slice(parts, above + 1, F.size(parts))
    name = F.element_at(parts, -1)
    dropped = F.exists(below, lambda x: matches_any(x, exclude)) if exclude else F.lit(False)
    verdict = F.when(dropped, "excluded").when(sensitive_name(name), "sensitive").when(~matches_any(name, patterns), "unmatched").otherwise("take")
    return files.select("path", name.alias("name"), F.col("length").alias("size"), verdict.alias("verdict"))


def read_files(spark: SparkSession, root: str, patterns: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDE, limit: int | None = None) -> DataFrame:
    """``id, source, title, text, encoding, suffix, size, truncated`` of the text files below ``root``.

    Binary files are left out.  ``limit`` keeps the first files by path.  Names
    are judged before contents are read; unreadable files are skipped.  Spark does
    not list empty files and names that begin with a dot or an underscore.
    """
    listed = list_files(spark, root, patterns, exclude).where("verdict = 'take'").select("path", "name")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)

    @F.arrow_udf("struct<text: string, encoding: string>")
    def decoded(batch: pa.Array) -> pa.Array:
        got = [(None, None) if b is None else decode(b) for b in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in (0, 1)], ["text", "encoding"])

    text = files.join(listed, "path").where(~looks_binary(F.col("content")))
    if limit is not None:
        text = text.orderBy("path").limit(limit)
    d = text.withColumn("d", decoded(F.substring("content", 1, MOST)))
    suffix = F.lower(F.regexp_extract("name", r"[^.](\.[^.]+)$", 1))
    return d.select(
        content_id(F.col("path"), F.col("d.text")).alias("id"),
        F.col("path").alias("source"),
        F.col("name").alias("title"),
        F.col("d.text").alias("text"),
        F.col("d.encoding").alias("encoding"),
        suffix.alias("suffix"),
        F.col("length").alias("size"),
        (F.col("length") > MOST).alias("truncated"),
        mime_type(suffix).alias("mime_type"),
    )


def documents_below(spark: SparkSession, roots: Sequence[str], patterns: Sequence[str] = (), exclude: Sequence[str] = DEFAULT_EXCLUDE, limit: int | None = None) -> DataFrame:
    """Documents (source, title, text, mime_type, metadata) of the text files below several folders, each once; ``limit`` counts files that could be read."""
    found = reduce(DataFrame.unionByName, [read_files(spark, r, patterns, exclude) for r in roots]).dropDuplicates(["source"])
    if limit is not None:
        found = found.orderBy("source").limit(limit)
    about = F.create_map(F.lit("name"), "title", F.lit("suffix"), "suffix", F.lit("encoding"), "encoding", F.lit("size"), F.col("size").cast("string"))
    return found.select("source", "title", "text", "mime_type", about.alias("metadata"))
