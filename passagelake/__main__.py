"""Command line: python -m passagelake <command>."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import config as settings
from .agent.corpus_tools import corpus_tools, hit
from .agent.loop import Agent
from .agent.providers import Message, default_providers
from .engine import Engine
from .evaluate import QUESTIONS, SAMPLE, evaluate, latencies
from .server import Service, serve
from .sources import files
from .sources.sessions import Sessions
from .sources.store import PassageStore

#: Settings that every command takes as options.
GIVEN = ("store", "embedder", "provider", "mode", "fusion", "rerank", "lexical_weight", "vector_weight", "rrf_k", "k1", "b", "multiplier", "min_score")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("passagelake")
    p.add_argument("--config")
    for name in GIVEN:
        p.add_argument(f"--{name}")
    p.add_argument("--top-k", type=int)
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("rebuild", "cut and embed all documents again"), ("stats", "sizes"), ("sources", "documents"), ("config", "the settings in force"), ("providers", "who can answer"), ("eval", "measures of each mode on a sample")):
        sub.add_parser(name, help=about)
    index = sub.add_parser("index", help="add files below folders")
    index.add_argument("paths", nargs="+")
    index.add_argument("--pattern", action="append", default=[])
    index.add_argument("--limit", type=int)
    for name in ("search", "ask", "chat", "show", "bench"):
        c = sub.add_parser(name)
        c.add_argument("text", nargs="+" if name == "bench" else None)
        if name == "chat":
            c.add_argument("--session", default="default")
        if name == "show":
            c.add_argument("--chars", type=int, default=2000)
    sub.add_parser("init", help="write a settings file").add_argument("file")
    sub.add_parser("serve", help="answer over HTTP").add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    c = settings.load(a.config, top_k=a.top_k, **{n: getattr(a, n) for n in GIVEN})
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str), file=out)
    if a.command == "config":
        say({k: v for k, v in vars(c).items() if k != "token"})
        return 0
    if a.command == "init":
        settings.save(c, a.file)
        return 0
    spark = spark or SparkSession.builder.appName("passagelake").getOrCreate()
    store = PassageStore(spark, c.store, c.chunks(), c.embedder)
    if a.command == "index":
        docs = files.documents_below(spark, a.paths, a.pattern, limit=a.limit)
        say({"version": store.add(docs)})
        return 0
    if a.command == "rebuild":
        say({"version": store.rebuild(embedder=c.embedder)})
        return 0
    providers = default_providers(spark)
    if a.command == "providers":
        say(providers.names())
        return 0
    if a.command == "eval":
        if store.version() == 0:
            store.add(spark.createDataFrame([(s, t, s) for s, t in SAMPLE], "source string, text string, title string"))
        for r in evaluate(Engine(store, c.search()), QUESTIONS, c.top_k).collect():
            say(r.asDict())
        return 0
    engine = Engine(store, c.search())
    if a.command == "stats":
        say(store.stats().first().asDict())
    elif a.command == "sources":
        for r in store.sources(limit=200).collect():
            say(r.asDict())
    elif a.command == "show":
        found = engine.show(a.text).first()
        say(found["text"][: a.chars] if found else f"no source holds {a.text!r}")
        return 0 if found else 1
    elif a.command == "search":
        for r in engine.search(a.text, c.top_k, c.mode).orderBy("rank").collect():
            say(hit(r))
    elif a.command == "bench":
        say(latencies(engine, a.text, c.top_k, c.mode))
    elif a.command in ("ask", "chat"):
        sessions = Sessions(spark, f"{c.store}/sessions")
        before = [Message(r["role"], r["text"]) for r in sessions.load(a.session, 50).collect()] if a.command == "chat" else []
        run = Agent(providers.get(c.provider), corpus_tools(engine, c.top_k)).run(a.text, before)
        if a.command == "chat":
            sessions.append(a.session, [("user", a.text), ("assistant", run.answer)])
        say(run.answer)
        return 0 if run.stop == "final_answer" else 1
    elif a.command == "serve":
        serve(Service(engine, providers.get(c.provider), c.token), port=a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
