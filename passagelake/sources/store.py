"""A passage store of Parquet parts and published manifests: writers add a part, readers hold the version they opened.

Every change writes only what is new, as a part: documents with their passages, postings in blocks of whole passages (see
``operators.blocks``), vectors and the statistics of their terms; vectors that replace others; or ids that are gone, with what their passages take from the statistics.  A version
is a small JSON manifest that names its parts in order.  Reading merges them: a row counts unless a later part removed its
document, and of a passage's vectors the latest counts, in one scan a table whatever the number of parts; ``compact`` makes them one.

A version counts once its manifest is there, whole.  A writer claims the next number first (creating a file that must not
exist).  One that finds its base overtaken looks at what came between: changes of other documents stay and its own parts go on
top; a change of the same documents is a conflict.  ``transaction`` publishes several changes as one version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..operators import blocks as bl
from ..operators import embedding, ranking
from ..operators.chunking import ChunkOptions, chunks
from .shared import LEASE, Conflict, Folder, freeing, publish

SCHEMAS = {
    "documents": "id string, source string, title string, mime_type string, text string, metadata map<string,string>, added long",
    "chunks": "id string, chunk_id string, ordinal long, text string, source string, title string, mime_type string",
    "blocks": "keys array<struct<id:string,chunk_id:string>>, length long, words string, lengths binary, found binary, own binary, word binary, tf binary",
    "vectors": "id string, chunk_id string, embedding array<float>",
    "stats": "term string, df long, length long",
}
FORMAT = 3
#: Bytes of a row group of a part, so that the files of few tasks can be read by many.
GROUP = 8 << 20
#: Parts from which ``compact`` makes one.
MOST_PARTS = 16


class EmbedderMismatch(ValueError):
    """The store's vectors come from another embedder."""


class NoVectors(ValueError):
    """The embedder could not answer."""


class PassageStore:
    """Documents by content id, their passages, and these passages' postings and vectors."""

    def __init__(self, spark: SparkSession, path: str, options: ChunkOptions = ChunkOptions(), embedder: str = "hashing:512", services: dict[str, Callable] | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._embed, self.embedder = embedding.build_embedder(embedder, services)
        self._open: tuple[int, dict] | None = None  # of a transaction: its base, and the manifest so far

    # -- versions ------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The last published version; 0 for a new store."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``parts``, ``structure`` and ``append`` revisions, ``embedder`` and free ``meta`` of a version."""
        if version is None and self._open:
            return self._open[1]
        v = self.version() if version is None else version
        if v == 0:
            return {"format": FORMAT, "parts": [], "structure": 0, "append": 0, "embedder": self.embedder, "meta": {}}
        lines = self.spark.read.text(f"{self.path}/versions/v{v}.json", wholetext=True).first()
        found = json.loads(lines["value"])
        if found["format"] > FORMAT:
            raise ValueError(f"the store has format {found['format']}, this library reads up to {FORMAT}")
        if found["format"] < FORMAT and found["parts"]:
            raise ValueError(f"the store has format {found['format']}, whose parts hold postings as rows; add its documents to a new store")
        return found

    def _publish(self, base: int, manifest: dict) -> int:
        """Put the manifest in place as version ``base + 1``; a claim that outlived ``LEASE`` is taken over."""
        publish(self._fs, self._path, f"{self.path}/versions/v{base + 1}", manifest | {"format": FORMAT})
        return base + 1

    def _start(self) -> tuple[int, dict]:
        """The base of a change: the last version, or what a transaction has made of it."""
        if self._open:
            return self._open
        base = self.version()
        return base, self.manifest(base)

    def _commit(self, base: int, old: dict, new: dict, tries: int = 20) -> int:
        """Publish ``new``, made from ``old``, or, in a transaction, keep it until the end."""
        if self._open:
            self._open = (base, new)
            return base
        for k in range(tries):
            try:
                return self._publish(base, new)
            except Conflict:
                if k + 1 == tries:
                    raise
            if self.version() == base:  # claimed, and not yet there
                time.sleep(0.2)
                continue
            base, now = self.version(), self.manifest()
            new, old = self._rebased(old, new, now), now
        raise AssertionError

    def _rebased(self, old: dict, new: dict, now: dict) -> dict:
        """``new`` on top of ``now``, where ``now`` added to ``old`` (or merged its parts) what touches other documents only."""
        names = lambda m: [x["name"] for x in m["parts"]]
        had = names(old)

        def since(m: dict) -> list[dict] | None:
            """The parts that came after ``old``, if what ``old`` had still stands in front, as it was or merged."""
            merged = m["parts"][0].get("of", []) if m["parts"] else []
            n = 1 if merged and merged == had else len(had)
            return m["parts"][n:] if n == 1 and merged == had or names(m)[: len(had)] == had else None

        theirs, mine = since(now), since(new)
        if theirs is None or mine is None or old["embedder"] != now["embedder"] or new["embedder"] not in (old["embedder"], now["embedder"]):
            raise Conflict("the store was rebuilt or cleared in between")
        if theirs and mine and not self._touched(theirs).join(self._touched(mine), "id", "left_semi").isEmpty():
            raise Conflict("another writer changed the same documents in between")
        front = new["parts"][: len(new["parts"]) - len(mine)] if names(new)[: len(had)] != had else now["parts"][: len(now["parts"]) - len(theirs)]
        return now | {"parts": [*front, *theirs, *mine], "meta": now["meta"] | new["meta"]} | {c: now[c] + new[c] - old[c] for c in ("append", "structure")}

    def _touched(self, parts: list[dict]) -> DataFrame:
        ids = [self.spark.read.parquet(f"{self.path}/parts/{x['name']}/{x['touches']}").select("id") for x in parts]
        return reduce(DataFrame.union, ids).distinct()

    @contextmanager
    def transaction(self) -> Iterator[PassageStore]:
        """Changes made within are seen here only, and published as one version at the end; after an error, none of them is."""
        if self._open:  # the outermost one publishes
            yield self
            return
        base = self.version()
        old = self.manifest(base)
        self._open = (base, old)
        try:
            yield self
            new = self._open[1]
        finally:
            self._open = None
        if new != old:
            self._commit(base, old, new)

    def sweep(self, lease: float = LEASE) -> int:
        """Remove parts that no version names and claims without a version, if older than ``lease`` seconds; how many."""
        versions, old = range(1, self.version() + 1), time.time() - lease
        named = {x["name"] for v in versions for x in self.manifest(v)["parts"]}
        dead = [f"{self.path}/versions/v{self.version() + 1}.claim"]
        parts = self._path(f"{self.path}/parts")
        dead += [f"{self.path}/parts/{f.getPath().getName()}" for f in (self._fs.listStatus(parts) if self._fs.exists(parts) else []) if f.getPath().getName() not in named]
        gone = [p for p in map(self._path, dead) if self._fs.exists(p) and self._fs.getFileStatus(p).getModificationTime() / 1000 <= old]
        return sum(bool(self._fs.delete(p, True)) for p in gone)

    def release(self) -> bool:
        """Give up the claim of a writer that died before it published; whether there was one."""
        return bool(self._fs.delete(self._path(f"{self.path}/versions/v{self.version() + 1}.claim"), False))

    def set_meta(self, key: str, value: str) -> int:
        base, m = self._start()
        return self._commit(base, m, m | {"meta": m["meta"] | {key: value}})

    def get_meta(self, key: str, version: int | None = None) -> str | None:
        return self.manifest(version)["meta"].get(key)

    # -- tables ---------------------------------------------------------------------------------------------------

    def table(self, name: str, version: int | None = None, columns: Sequence | None = None) -> DataFrame:
        """One of the tables of ``SCHEMAS``, or ``postings`` as rows, as of a version: without what was deleted after it was written,
        vectors as last put.

        ``columns`` (names and expressions, ``id`` among them) are made where the rows are read, so that a join with what was deleted
        carries nothing else.
        """
        if name == "postings":
            rows = bl.postings(self.table("blocks", version), empty=True)
            return rows.select("key.id", "key.chunk_id", "term", "tf", "dl")
        parts = [x | {"place": k} for k, x in enumerate(self.manifest(version)["parts"])]
        inserted = [x for x in parts if name in x["tables"] and x["kind"] == "insert"]
        put = [x for x in parts if name == "vectors" and x["kind"] == "vectors"]
        gone = [x for x in parts if x["kind"] == "gone"]
        if name == "stats":
            return self._scan("stats", [x for x in parts if "stats" in x["tables"]]).drop("place")
        rows = self._scan(name, inserted)
        if gone:
            last = self._scan("gone", gone, "id string").groupBy("id").agg(F.max("place").alias("gone"))
        if name == "blocks":
            return self._picked(rows, last, False) if gone else rows.drop("place")
        if gone:
            alive = lambda df: df.join(last, "id", "left").where("gone is null or gone < place").drop("gone")
        else:
            alive = lambda df: df
        wanted = [*(columns or [c.split()[0] for c in SCHEMAS[name].split(", ")])]
        if put:
            of = F.struct("place", "embedding", "id")
            new = alive(self._scan(name, put)).groupBy("chunk_id").agg(F.max(of).alias("x")).select("x.id", "chunk_id", "x.embedding", "x.place")
            rows = alive(rows).join(new.select("chunk_id"), "chunk_id", "left_anti").select(*new.columns).unionAll(new)
            return rows.select(*wanted)
        return alive(rows.select(*wanted, "place")).drop("place")

    def _picked(self, blocks: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
        """Blocks (with their part's place) of the passages of these ids (id, gone: a later place), or of all others.

        The ids meet the passages' keys alone; what goes to the blocks is a list of places for each.
        """
        blocks = blocks.withColumn("first", F.get("keys", 0)["chunk_id"])  # once in a part
        each = blocks.select("place", "first", F.posexplode("keys.id").alias("position", "id"))
        lists = each.join(ids, "id").where("gone > place").groupBy("place", "first").agg(F.collect_list("position").alias("picked"))
        lists = Folder(self.spark, "picked").keep(lists, "picked")  # Spark knows how few they are
        return bl.picked(blocks.join(lists, ["place", "first"], "inner" if keep else "left"), "picked", keep)

    def _scan(self, table: str, parts: list[dict], schema: str | None = None) -> DataFrame:
        """A table's rows in these parts, with the part's ``place``, by one scan."""
        kind = schema or SCHEMAS[table]
        if not parts:
            return self.spark.createDataFrame([], f"{kind}, place int")
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/parts/{x['name']}/{table}" for x in parts])
        if len(parts) == 1:
            return rows.withColumn("place", F.lit(parts[0]["place"]))
        places = self.spark.createDataFrame([(x["name"], x["place"]) for x in parts], "part string, place int")
        part = F.element_at(F.split("_metadata.file_path", "/"), -3)
        return rows.withColumn("part", part).join(F.broadcast(places), "part").drop("part")  # a row for each part

    def documents(self, version: int | None = None, columns: Sequence | None = None) -> DataFrame:
        return self.table("documents", version, columns)

    def chunks(self, version: int | None = None) -> DataFrame:
        return self.table("chunks", version)

    def rows(self, version: int | None = None) -> DataFrame:
        """Every passage with its vector, null where it has none, in order of documents and passages."""
        return self.chunks(version).join(self.table("vectors", version).drop("id"), "chunk_id", "left").orderBy("id", "ordinal")

    # -- changes --------------------------------------------------------------------------------------------------

    def _write(self, kind: str, touches: str, tables: dict[str, DataFrame]) -> dict:
        name = uuid.uuid4().hex
        for table, df in tables.items():
            columns = [c.split()[0] for c in SCHEMAS.get(table, "id string").split(", ")]
            self._put(df.select(*columns), f"{self.path}/parts/{name}/{table}")
        return {"name": name, "kind": kind, "touches": touches, "tables": sorted(tables)}

    def _put(self, df: DataFrame, path: str) -> None:
        few = 10  # rows that are written before their bytes are counted
        with freeing(self.spark):
            df.write.option("compression", "zstd").option("parquet.block.size", GROUP).option("parquet.page.size.row.check.min", few).parquet(path)

    @staticmethod
    def _statistics(blocks: DataFrame, sign: int = 1) -> DataFrame:
        """``term, df, length`` of these postings; under the empty term the number of passages and their length together."""
        terms = bl.frequencies(blocks).select("term", (sign * F.col("df")).alias("df"), F.lit(0).cast("long").alias("length"))
        whole = [F.coalesce(F.sum(x), F.lit(0)).cast("long") * sign for x in (F.size("keys").cast("long"), F.col("length"))]
        return terms.union(blocks.agg(F.lit(""), *whole))

    def _indexed(self, documents: DataFrame) -> dict:
        """Write documents as one part, with their passages, postings, vectors and statistics."""
        part = self._write("insert", "documents", {"documents": documents})
        place = f"{self.path}/parts/{part['name']}"
        stored = lambda table: self.spark.read.schema(SCHEMAS[table]).parquet(f"{place}/{table}")
        cut = chunks(stored("documents").select(F.col("id").alias("doc_id"), "source", "text", "title", "mime_type"), self.options)
        # Passages are keyed by the stored id, which chunks() makes from the same parts.
        self._put(cut.select(F.col("doc_id").alias("id"), "chunk_id", "ordinal", "text", "source", "title", "mime_type"), f"{place}/chunks")
        # Each passage is a key of its own: its words are counted, and it is embedded, where it is read.
        self._put(bl.blocked(stored("chunks").select(F.struct("id", "chunk_id").alias("key"), "text")), f"{place}/blocks")
        self._put(self._statistics(stored("blocks")), f"{place}/stats")
        vectors = embedding.hashed(stored("chunks").select(F.struct("id", "chunk_id").alias("k"), "text"), key="k", embedder=self._embed)
        self._put(vectors.select("k.id", "k.chunk_id", "embedding"), f"{place}/vectors")
        return part | {"tables": sorted(SCHEMAS)}

    def _guard(self, manifest: dict) -> None:
        if manifest["parts"] and manifest["embedder"] != self.embedder:
            raise EmbedderMismatch(f"the store's vectors come from {manifest['embedder']}, not from {self.embedder}; rebuild(embedder=...) makes new ones")

    def add(self, documents: DataFrame) -> int:
        """Insert documents (source, text; title, mime_type and metadata where there) whose content is new; returns the version.

        Of equal ones the first title stays.  Nulls in source and text count as empty.  Only new documents are cut, counted
        and embedded; a document without passages is stored too.
        """
        base, m = self._start()
        self._guard(m)
        have = lambda c, kind: F.col(c) if c in documents.columns else F.lit(None).cast(kind)
        rows = documents.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), have("title", "string").alias("title"), have("mime_type", "string").alias("mime_type"), have("metadata", "map<string,string>").alias("metadata"))
        rows = rows.withColumn("id", content_id(F.col("source"), F.col("text")))
        rows = rows.groupBy("id").agg(F.first("source").alias("source"), F.min("title").alias("title"), F.min("mime_type").alias("mime_type"), F.first("text").alias("text"), F.first("metadata").alias("metadata"))
        new = rows.join(self.documents(self._seen(base)).select("id"), "id", "left_anti").withColumn("mime_type", F.coalesce("mime_type", F.lit("text/plain"))).withColumn("added", F.lit(base + 1).cast("long"))
        part = self._indexed(new)
        return self._commit(base, m, m | {"parts": [*m["parts"], part], "append": m["append"] + 1, "embedder": self.embedder})

    def _seen(self, base: int) -> int | None:
        """The version a change reads: its base, or the open transaction."""
        return None if self._open else base

    def add_text(self, source: str, text: str, title: str | None = None, **metadata: str) -> str:
        """Insert one text; its id."""
        row = [(source, text, title, {k: str(v) for k, v in metadata.items()})]
        df = self.spark.createDataFrame(row, "source string, text string, title string, metadata map<string,string>")
        self.add(df)
        return df.select(content_id(F.col("source"), F.col("text")).alias("id")).first()["id"]

    def put_vectors(self, vectors: DataFrame) -> int:
        """Insert or replace vectors (chunk_id, embedding) of stored passages; they must be finite and of the store's length.

        Only these are written.  Of several vectors for one passage in a call the greatest counts, in the order of arrays.
        """
        base, m = self._start()
        at = self._seen(base)
        one = vectors.groupBy("chunk_id").agg(F.max(F.col("embedding").cast("array<float>")).alias("embedding"))
        new = self.chunks(at).select("id", "chunk_id").join(one, "chunk_id")
        dims = self.table("vectors", at).agg(F.max(F.size("embedding")).alias("d")).first()["d"]
        part = self._write("vectors", "vectors", {"vectors": new})
        put = self._scan("vectors", [part | {"place": 0}])
        if not put.where(~F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) | (F.size("embedding") != (dims or -1))).isEmpty():
            self._fs.delete(self._path(f"{self.path}/parts/{part['name']}"), True)
            raise ValueError(f"vectors must be finite and of {dims} numbers")
        return self._commit(base, m, m | {"parts": [*m["parts"], part], "structure": m["structure"] + 1})

    def delete(self, ids: Sequence[str] | DataFrame) -> int:
        """Remove documents, their passages, postings and vectors; returns the number of passages removed.  Unknown ids publish nothing."""
        base, m = self._start()
        at = self._seen(base)
        asked = ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone = self.documents(at).join(asked.distinct(), "id", "left_semi").select("id")
        part = self._write("gone", "gone", {"gone": gone})
        gone = self.spark.read.schema("id string").parquet(f"{self.path}/parts/{part['name']}/gone")
        if gone.isEmpty():
            self._fs.delete(self._path(f"{self.path}/parts/{part['name']}"), True)
            return 0
        those = self._picked(self.table("blocks", at).withColumn("place", F.lit(0)), gone.withColumn("gone", F.lit(1)), True)
        self._put(self._statistics(those, -1), f"{self.path}/parts/{part['name']}/stats")
        n = self.chunks(at).join(gone, "id", "left_semi").count()
        part["tables"] = ["gone", "stats"]
        self._commit(base, m, m | {"parts": [*m["parts"], part], "structure": m["structure"] + (n > 0)})
        return n

    def clear(self, keep_documents: bool = False) -> int:
        base, m = self._start()
        parts = [self._write("insert", "documents", {"documents": self.documents(self._seen(base))})] if keep_documents else []
        return self._commit(base, m, m | {"parts": parts, "structure": m["structure"] + 1})

    def rebuild(self, options: ChunkOptions | None = None, embedder: str | None = None, services: dict[str, Callable] | None = None) -> int:
        """Cut, count and embed all stored documents again, as one part; readers see the old version until the new one is whole."""
        self.options = options or self.options
        if embedder:
            self._embed, self.embedder = embedding.build_embedder(embedder, services)
        base, m = self._start()
        part = self._indexed(self.documents(self._seen(base)))
        return self._commit(base, m, m | {"parts": [part], "structure": m["structure"] + 1, "embedder": self.embedder})

    def compact(self, most_parts: int = MOST_PARTS) -> int:
        """Merge the parts into one where there are more than ``most_parts``: the same rows, without what later parts replaced or
        removed.  Changes that other writers publish meanwhile stay on top."""
        base, m = self._start()
        if len(m["parts"]) <= most_parts:
            return base
        at = self._seen(base)
        tables = {name: self.table(name, at) for name in SCHEMAS}
        tables["stats"] = tables["stats"].groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where("df <> 0 or term = ''")
        part = self._write("insert", "documents", tables) | {"of": [x["name"] for x in m["parts"]]}
        return self._commit(base, m, m | {"parts": [part]})

    # -- look-ups -------------------------------------------------------------------------------------------------

    def document(self, id_: str, version: int | None = None) -> DataFrame:
        return self.documents(version).where(F.col("id") == id_)

    def by_source(self, source: str, version: int | None = None) -> DataFrame:
        """The document that was added last under exactly this source."""
        return self.documents(version).where(F.col("source") == source).orderBy(F.col("added").desc(), F.col("id").desc()).limit(1)

    def chunk(self, chunk_id: str, version: int | None = None) -> DataFrame:
        return self.chunks(version).where(F.col("chunk_id") == chunk_id)

    def chunks_in_order(self, chunk_ids: Sequence[str], version: int | None = None) -> DataFrame:
        """``pos`` and the passage for each id in the caller's order; unknown ids are missing, repeated ones repeat."""
        asked = self.spark.createDataFrame(list(enumerate(chunk_ids)), "pos long, chunk_id string")
        return asked.join(self.chunks(version), "chunk_id").orderBy("pos")

    def stats(self, version: int | None = None) -> DataFrame:
        """One row: ``n_documents, n_sources, n_chunks, n_vectors, dim, embedder, chunk_size, chunk_overlap, version``."""
        v = self.version() if version is None else version
        d = self.documents(v).agg(F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"))
        x = self.table("vectors", v).agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dim"))
        one = [self.chunks(v).agg(F.count("*").alias("n_chunks")), x]
        fixed = {"embedder": self.manifest(v)["embedder"], "chunk_size": self.options.size, "chunk_overlap": self.options.overlap, "version": v}
        return reduce(DataFrame.crossJoin, one, d).select("*", *[F.lit(x).alias(c) for c, x in fixed.items()])  # one row each

    def sources(self, version: int | None = None, limit: int | None = None) -> DataFrame:
        """Each document with its number of passages, those without any included, the newest first."""
        v = self.version() if version is None else version
        n = self.chunks(v).groupBy("id").agg(F.count("*").alias("n_chunks"))
        out = self.documents(v).join(n, "id", "left").select("id", "source", "title", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "added")
        out = out.orderBy(F.col("added").desc(), "source", "id")
        return out if limit is None else out.limit(limit)

    def neighbours(self, chunk_ids: Sequence[str], reach: int = 1, version: int | None = None) -> DataFrame:
        """The passages within ``reach`` places of the given ones in their documents, each once."""
        cut = self.chunks(version)
        at = cut.where(F.col("chunk_id").isin(list(chunk_ids))).select("id", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("ordinal")).distinct()
        return cut.join(at, ["id", "ordinal"])

    def lexical(self, version: int | None = None) -> ranking.LexicalIndex:
        """The stored postings as an index over passages, weights and lengths written once for each version from the parts' statistics:
        no posting is read for them.

        Passages without terms count in the mean length.
        """
        v = self.version() if version is None else version
        root = f"{self.path}/index/v{v}"

        def keep(df: DataFrame, name: str) -> DataFrame:
            if not self._fs.exists(self._path(f"{root}/{name}/_SUCCESS")):
                with freeing(self.spark):
                    df.write.mode("overwrite").parquet(f"{root}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{root}/{name}")

        blocks = self.table("blocks", v).withColumn("keys", F.col("keys.chunk_id"))
        return ranking.LexicalIndex.merged(blocks, self.table("stats", v), keep=keep)

    def embed_queries(self, texts: Sequence[str]) -> list[list[float]]:
        """Vectors of a few texts, made here."""
        try:
            return embedding.checked(self._embed(list(texts)), len(texts)).tolist()
        except Exception as e:
            raise NoVectors(str(e)) from e

    def embedded(self, texts: DataFrame, key: str) -> DataFrame:
        """``key, embedding`` of texts (key, text), made on the executors."""
        return embedding.hashed(texts, key=key, embedder=self._embed)
