"""Stored conversations: a folder for each, with its messages as Parquet parts and a log that numbers them.

An append writes its messages first, then claims the log's next number (creating a file that must not exist) and publishes an
entry: which part, from which turn on, how many messages.  Turns come from the log alone, so appends at once get turns
after each other without gaps, and what a killed writer left without an entry is not seen.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation
from .shared import LEASE, Conflict, publish

SCHEMA = "conv_id string, turn long, role string, text string, title string, at double"
_PART = "part string, ordinal long, conv_id string, role string, text string, title string, at double"
_ENTRY = "part string, first long, count long"


class Sessions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _folder(self, conv_id: str) -> str:
        return f"{self.path}/session-{hashlib.sha256(conv_id.encode()).hexdigest()[:32]}"

    def _numbered(self, folders: str) -> DataFrame:
        """The messages of parts that the logs below ``folders`` name, with their turns."""
        entries = self.spark.read.schema(_ENTRY).json(f"{folders}/log/*.json")
        parts = self.spark.read.schema(_PART).parquet(f"{folders}/parts/*")
        return parts.join(entries, "part").select("conv_id", (F.col("first") + F.col("ordinal")).alias("turn"), "role", "text", "title", "at")

    def messages(self) -> DataFrame:
        """All conversations' messages."""
        found = self._names(self.path)
        if any(not n.startswith(("session-", "_", ".")) for n in found):
            raise ValueError(f"{self.path} holds sessions of the format before logs; append them to a new folder")
        return self._of([f"{self.path}/{n}" for n in found if n.startswith("session-")], f"{self.path}/session-*")

    def _of(self, folders: list[str], pattern: str) -> DataFrame:
        """The messages below ``pattern``, none if no folder has an entry yet."""
        if not any(n.endswith(".json") for f in folders for n in self._names(f"{f}/log")):
            return self.spark.createDataFrame([], SCHEMA)
        return self._numbered(pattern)

    def _last(self, folder: str) -> tuple[int, int]:
        """The number of the log's next entry, and the turn it begins with."""
        k = max((int(n[:-5]) for n in self._names(f"{folder}/log") if n.endswith(".json")), default=-1)
        if k < 0:
            return 0, 0
        entry = json.loads(self.spark.read.text(f"{folder}/log/{k:012}.json", wholetext=True).first()["value"])
        return k + 1, entry["first"] + entry["count"]

    def append(self, conv_id: str, messages: Sequence[tuple[str, str]], title: str | None = None) -> int:
        """Add (role, text) messages; the turn of the last, -1 in a session without any.  Turns go on from the session's last one, whoever appends beside."""
        folder, part = self._folder(conv_id), uuid.uuid4().hex
        if not messages:
            return self._last(folder)[1] - 1
        rows = [(part, k, conv_id, role, text, title, time.time()) for k, (role, text) in enumerate(messages)]
        self.spark.createDataFrame(rows, _PART).coalesce(1).write.parquet(f"{folder}/parts/{part}")
        while True:
            number, first = self._last(folder)
            try:
                publish(self._fs, self._path, f"{folder}/log/{number:012}", {"part": part, "first": first, "count": len(rows)})
                return first + len(rows) - 1
            except Conflict:  # published by now, or about to be; a dead writer's claim is taken over after its lease
                time.sleep(random.uniform(0.02, 0.2))

    def load(self, conv_id: str, limit: int | None = None) -> DataFrame:
        """A session's messages in order; with ``limit`` the last ones.  Reads this session's folder only."""
        folder = self._folder(conv_id)
        mine = self._of([folder], folder)
        return (mine if limit is None else conversation.tail(mine, limit)).orderBy("turn")

    def listing(self, limit: int = 50) -> DataFrame:
        """``conv_id, title, n_messages, updated``, the newest first."""
        m = self.messages().groupBy("conv_id").agg(F.max("title").alias("title"), F.count("*").alias("n_messages"), F.max("at").alias("updated"))
        return m.orderBy(F.col("updated").desc(), "conv_id").limit(limit)

    def sweep(self, lease: float = LEASE) -> int:
        """Remove parts that no entry names, if older than ``lease`` seconds; how many."""
        gone, old = 0, time.time() - lease
        for folder in (f"{self.path}/{n}" for n in self._names(self.path) if n.startswith("session-")):
            # Parts first: one listed here either has its entry when the log is read, or is still within its lease.
            parts = [f"{folder}/parts/{n}" for n in self._names(f"{folder}/parts")]
            named = {r["part"] for r in self.spark.read.schema(_ENTRY).json(f"{folder}/log/*.json").select("part").collect()} if any(n.endswith(".json") for n in self._names(f"{folder}/log")) else set()
            for p in parts:
                if p.rpartition("/")[2] not in named and self._fs.getFileStatus(self._path(p)).getModificationTime() / 1000 <= old:
                    gone += bool(self._fs.delete(self._path(p), True))
        return gone
