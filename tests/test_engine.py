import io
import json
import threading
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake import __main__ as cli
from passagelake import config, evaluate
from passagelake.agent import providers
from passagelake.agent.corpus_tools import corpus_tools
from passagelake.agent.loop import Agent, LoopOptions
from passagelake.agent.tools import Call, Registry, ToolError, arguments_for, as_text, tool
from passagelake.engine import Engine, SearchOptions
from passagelake.operators import embedding, memory, ranking
from passagelake.server import Service, serve
from passagelake.sources import files
from passagelake.sources.sessions import Sessions
from passagelake.sources.store import PassageStore


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    store = PassageStore(spark, str(tmp_path_factory.mktemp("engine")))
    store.add(spark.createDataFrame([(s, t, s) for s, t in evaluate.SAMPLE] + [("zh/notes.md", "数据库迁移需要备份。索引可以提高查询速度。", None), ("x/tide.md", "Another file of that name.", None)], "source string, text string, title string"))
    return Engine(store)


def test_search_modes_and_guards(spark, engine):
    for mode in ("hybrid", "lexical", "vector"):
        top = engine.search("harbour gates at high tide", 3, mode).orderBy("rank").collect()
        assert top[0]["source"] == "tide.md" and [r["rank"] for r in top] == list(range(1, len(top) + 1))
        assert set(top[0]["contributions"]) == ({"lexical", "vector"} if mode == "hybrid" else {mode})
    assert engine.search("索引 查询", 2, "lexical").first()["source"] == "zh/notes.md"
    assert engine.search("  ", 3).count() == 0 and engine.search("tide", 0, "no mode").count() == 0
    with pytest.raises(ValueError):
        engine.search("tide", 3, "no mode")
    assert engine.search("harbour gates", 3, source_filter="bread").where("source <> 'bread.md'").count() == 0
    many = spark.createDataFrame([(1, "rye starter"), (2, "queen hive"), (3, None)], "query_id long, query string")
    assert {r["query_id"]: r["source"] for r in engine.search(many, 1).collect()} == {1: "bread.md", 2: "bees.md"}
    before = engine.options
    engine.configure(rerank="overlap", fusion="DBSF", min_score=0.1)
    top = engine.search("rye starter", 3).collect()
    assert all(r["score"] >= 0.1 and r["contributions"]["rerank:overlap"] == pytest.approx(r["score"]) for r in top) and top
    engine.options = before
    for bad in ({"weights": {"lexical": -1.0, "vector": 1.0}}, {"weights": {"lexical": 0.0}}, {"fusion": "other"}, {"rerank": "other"}, {"multiplier": 0}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)


def test_vectors_that_cannot_be_had(engine, monkeypatch):
    monkeypatch.setattr(engine.store, "_embed", lambda texts: [[float("nan")]] * len(texts))
    assert engine.search("rye starter", 1).first()["source"] == "bread.md"
    with pytest.raises(ValueError):
        engine.search("rye starter", 1, "vector")


def test_nearest_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    v = [[float(x) for x in row] for row in rng.integers(-2, 3, (60, 3))] + [[0.0] * 3, [float("nan")] * 3, [1.0, 2.0]]
    asked = [(k, v[k]) for k in range(0, 14, 2)] + [(99, [3.0, 4.0])]
    got = ranking.cosine_topk(spark.createDataFrame(list(enumerate(v)), "key long, embedding array<double>").repartition(5), spark.createDataFrame(asked, "query_id long, query_vector array<double>"), 7)
    want = set()
    for q, x in asked:
        score = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), k) for k, y in enumerate(v) if len(x) == len(y) and np.linalg.norm(x) * np.linalg.norm(y) > 0]
        want |= {(q, k, r + 1) for r, (s, k) in enumerate(sorted(x for x in score if x[0] < 0)[:7])}
    assert {(r["query_id"], r["key"], r["rank"]) for r in got.collect()} == want


def test_answers_and_agent(spark, engine):
    run = Agent(providers.Extractive(spark), corpus_tools(engine)).run("when do the harbour gates close")
    assert run.stop == "final_answer" and run.turns == 2 and run.answer.startswith("The harbour gates close two hours before high tide. [1]") and "tide.md (chunk 0, score" in run.answer
    assert [s["tool"] for s in run.steps] == ["search"] and run.usage.prompt_tokens > 0 and json.dumps(run.as_dict())
    assert engine.ask("zzz").first()["answer"].startswith("Nothing")
    assert engine.read_source("elsewhere/tide.md")["error"] == "ambiguous_source" and engine.read_source("notes.md")["source"] == "zh/notes.md" and engine.read_source("no.md")["error"] == "not_found"
    assert engine.show("zh/").first()["source"] == "zh/notes.md"


class Scripted:
    name = "scripted"

    def __init__(self, *replies):
        self.replies = list(replies)

    def complete(self, request):
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply


def test_loop_stops():
    R, call = providers.Reply, Call("1", "double", {"x": "4"})

    @tool
    def double(x: int) -> int:
        """Twice x."""
        return 2 * x

    tools = Registry([double])
    run = Agent(Scripted(R(calls=(call,)), R("part. ", paused=True), R("eight")), tools).run("q")
    assert (run.stop, run.answer, run.turns, run.steps[0]["content"]) == ("final_answer", "part. eight", 3, "8")
    assert Agent(Scripted(R(calls=(call,)), R(calls=(call,))), tools, LoopOptions(turns=2)).run("q").stop == "max_turns"
    assert Agent(Scripted(R("t", calls=(call,)))).run("q").stop == "no_tools"
    assert Agent(Scripted(providers.ProviderError("down"))).run("q").stop == "provider_error"
    kinds = [e.kind for e in Agent(Scripted(R(calls=(call,)), R("One. Two.")), tools).stream("q")]
    assert kinds == ["call", "result", "text", "text", "done"]


def test_tools():
    @tool(requires_approval=True)
    def drop(name: str, n: int | None = None, kind: "list[int]" = []) -> str:  # noqa: B006
        """Drops it.

        More."""
        return name * 3

    assert drop.description == "Drops it." and drop.parameters["required"] == ["name"]
    assert drop.parameters["properties"] == {"name": {"type": "string"}, "n": {"type": "integer", "nullable": True}, "kind": {"type": "array", "items": {"type": "integer"}}}
    r = Registry([drop])
    say = lambda **kw: r.execute(Call("1", "drop", kw.pop("given", {"name": 5})), **kw)
    assert json.loads(say().content)["error"] == "not_approved" and say(approve=lambda c, t: True).content == "555"
    assert json.loads(say(approve=lambda c, t: True, given={"other": 1}).content)["error"] == "invalid_arguments"
    assert json.loads(r.execute(Call("1", "none", {})).content)["error"] == "unknown_tool"
    assert arguments_for(drop.parameters, {"name": "a", "n": " -7", "kind": [1.0]}) == {"name": "a", "n": -7, "kind": [1]}
    for bad in ({"name": "a", "n": True}, {"name": "a", "n": "x"}, {"name": "a", "kind": "b"}, {}, []):
        with pytest.raises(ToolError):
            arguments_for(drop.parameters, bad)
    with pytest.raises(ToolError):
        tool(lambda x: x)
    assert as_text(list(range(3000))).startswith('{"left_out": {"members": 1000}, "result": [0, 1')
    assert as_text({"a": "y" * 2500}) == '{"left_out": {"characters": 500}, "result": {"a": "' + "y" * 2000 + '"}}' and as_text({"a": [1]}) == '{"a": [1]}'
    assert as_text("x" * 100, 60) == "x" * 22 + "\n(100 characters in all; ask for less)" and len(as_text("x" * 100, 60)) == 60 and as_text("x" * 30, 30) == "x" * 30
    slow = Registry([tool(lambda: threading.Event().wait(5), name="slow")])
    assert json.loads(slow.execute(Call("1", "slow", {}), timeout=0.05).content)["error"] == "timeout"


def test_services_over_http():
    m = (providers.Message("system", "s"), providers.Message("user", "q"), providers.Message("assistant", "", (Call("1", "f", {"a": 1}),)), providers.Message("tool", "r", (), "1", "f"))
    body = providers.chat_body("m")(providers.Request(m))
    assert [x["role"] for x in body["messages"]] == ["system", "user", "assistant", "tool"] and body["messages"][2]["tool_calls"][0]["function"]["arguments"] == '{"a": 1}'
    blocks = providers.block_body("m")(providers.Request(m))
    assert blocks["system"] == "s" and blocks["messages"][-1]["content"][0]["tool_use_id"] == "1"
    with pytest.raises(providers.ProviderError):
        providers.block_body("m")(providers.Request(m[:3]))
    answer = io.BytesIO(json.dumps({"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3}}).encode())
    service = providers.HttpService("chat", "http://localhost/x", {}, providers.chat_body("m"), providers.chat_reply, send=lambda *_, **__: answer)
    assert service.complete(providers.Request(m)).text == "hi"
    down = providers.HttpService("chat", "http://localhost/x", {}, providers.chat_body("m"), providers.chat_reply, send=lambda *_, **__: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(providers.ProviderError) as e:
        down.complete(providers.Request(m))
    assert e.value.retryable


def test_embedders():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert embedding.with_retries(flaky, 3, lambda s: None)(7) == 7 and len(calls) == 3
    assert embedding.in_order([{"index": 1, "embedding": "b"}, {"index": 0, "embedding": "a"}], 2) == ["a", "b"]
    for bad in ([[1.0, 2.0]], [[float("inf")], [1.0]]):
        with pytest.raises(ValueError):
            embedding.checked(bad, 2, 1)
    assert list(embedding.batches(range(5), 2)) == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError):
        embedding.build_embedder("no:1")
    # Two words and their pair: slots from BLAKE2b by the formula, values 1 + ln(weight) over the norm.
    e = embedding.embed(["a", "b"], 8)
    assert [int(k) for k in np.flatnonzero(e)] == sorted({embedding.slot("a", 8), embedding.slot("b", 8), embedding.slot("a\x1fb", 8, True)}) and abs((e * e).sum() - 1) < 1e-6


def test_memory(spark):
    m = spark.createDataFrame([(1, k, "user", "x" * 40) for k in range(6)], "conv_id long, turn long, role string, text string")
    assert memory.windows(m, 1000, system="be brief").orderBy("turn").first()["text"] == "be brief" and memory.windows(m, 1000).count() == 6
    small = memory.windows(m, 30).orderBy("turn").collect()
    assert [(r["turn"], r["text"]) for r in small] == [(4, memory.HEAD + "- user:…"), (5, "x" * 40)]  # 7 tokens are left for lines
    assert [r["turn"] for r in memory.windows(m, 22).orderBy("turn").collect()] == [5]  # not even the head fits
    assert memory.windows(m, 60, summarize=False).count() == 3
    with pytest.raises(ValueError):
        memory.windows(m, 0)


def test_sessions_and_config(spark, tmp_path):
    s = Sessions(spark, str(tmp_path / "s"))
    assert s.load("a").count() == 0
    assert s.append("a", [("user", "one"), ("assistant", "two")], "title") == 1 and s.append("a", [("user", "three")]) == 2
    assert [r["text"] for r in s.load("a", 2).collect()] == ["two", "three"] and s.listing().first()["n_messages"] == 3
    c = config.load(None, {"PASSAGELAKE_TOP_K": "7", "PASSAGELAKE_MODE": "vector"}, mode="lexical", token="secret")
    assert (c.top_k, c.mode) == (7, "lexical")
    config.save(c, tmp_path / "c.json")
    tuned = config.load(None, {"PASSAGELAKE_K1": "1.2", "PASSAGELAKE_LEXICAL_WEIGHT": "0.5"}, rrf_k=10, b="0.5").search()
    assert (tuned.k1, tuned.b, tuned.rrf_k, tuned.weights) == (1.2, 0.5, 10, {"lexical": 0.5, "vector": 0.3})
    assert config.load(tmp_path / "c.json", {}).top_k == 7 and "secret" not in (tmp_path / "c.json").read_text()
    for bad in ({"chunk_overlap": 2000}, {"no_such": 1}, {"mode": "other"}):
        with pytest.raises(ValueError):
            config.load(None, {}, **bad)


def test_evaluation_and_cli(spark, engine, tmp_path):
    m = {r["mode"]: r for r in evaluate.evaluate(engine, k=3).collect()}
    assert m["lexical"]["n_queries"] == 5 and m["lexical"]["hit"] == 1.0 and m["hybrid"]["recall"] >= 0.9
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("The lighthouse keeper trims the wick at dusk.")
    (tmp_path / "in/b[1].py").write_text("wick = 3")
    out = io.StringIO()
    args = ["--store", str(tmp_path / "store")]
    assert cli.main([*args, "index", str(tmp_path / "in"), "--pattern", "*.md", "--pattern", "b[[]1].p[xy]"], spark, out) == 0
    assert cli.main([*args, "search", "lighthouse wick"], spark, out) == 0 and cli.main([*args, "stats"], spark, out) == 0
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert lines[0] == {"version": 1} and lines[1]["source"].endswith("a.md") and lines[-1]["n_documents"] == 2
    assert files.documents_below(spark, [str(tmp_path / "in")] * 2, limit=1).count() == 1


def test_http(spark, engine):
    service = Service(engine, providers.Extractive(spark), "t")
    assert service.handle("GET", "/health")[0] == 200 and service.handle("GET", "/stats")[0] == 401 and service.handle("GET", "/no")[0] == 404
    for body in ({"source": "../x", "content": "y"}, {"source": "a b", "content": "y"}, {"source": "x"}):
        assert service.handle("POST", "/documents", body, "t")[0] == 422
    assert service.handle("POST", "/search", {"query": "tide", "top_k": True}, "t")[0] == 422
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/search", b'{"query": "rye starter", "top_k": 1, "mode": "lexical"}', {"Authorization": "Bearer t"})
    got = json.loads(urllib.request.urlopen(ask, timeout=120).read())
    server.shutdown()
    assert got["count"] == 1 and got["results"][0]["source"] == "bread.md"
