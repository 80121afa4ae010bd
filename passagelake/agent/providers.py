"""What answers: a protocol, the extractive provider that needs no network, services over HTTP, and their registry."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import answers
from .tools import Call


@dataclass(frozen=True)
class Usage:
    prompt_tokens: int = 0
    completion_tokens: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.prompt_tokens + other.prompt_tokens, self.completion_tokens + other.completion_tokens)


@dataclass(frozen=True)
class Message:
    role: str
    text: str = ""
    calls: tuple[Call, ...] = ()
    call_id: str | None = None
    name: str | None = None
    is_error: bool = False


@dataclass(frozen=True)
class Request:
    messages: tuple[Message, ...]
    tools: dict[str, dict] = field(default_factory=dict)

    def question(self) -> str:
        return next((m.text for m in reversed(self.messages) if m.role == "user"), "")

    def since_question(self) -> list[Message]:
        last = max((k for k, m in enumerate(self.messages) if m.role == "user"), default=-1)
        return list(self.messages[last + 1 :])

    def tool_results(self) -> list[Message]:
        return [m for m in self.since_question() if m.role == "tool"]


@dataclass(frozen=True)
class Reply:
    text: str = ""
    calls: tuple[Call, ...] = ()
    usage: Usage = Usage()
    paused: bool = False


class ProviderError(RuntimeError):
    def __init__(self, message: str, status: int | None = None, retryable: bool = False):
        super().__init__(message)
        self.status, self.retryable = status, retryable


class Provider(Protocol):
    name: str

    def complete(self, request: Request) -> Reply: ...


def pieces(text: str) -> Iterator[str]:
    """A text as it streams: a sentence at a time."""
    yield from (p + " " for p in re.split(r"(?<=[.!?。！？])\s+", text) if p)


class Extractive:
    """Asks for a search first, then answers with cited sentences of what was found; the same question has the same answer."""

    name = "offline"

    def __init__(self, spark: SparkSession, search: str = "search"):
        self.spark, self.search = spark, search

    def complete(self, request: Request) -> Reply:
        question, results = request.question(), request.tool_results()
        if not results:
            if self.search in request.tools:
                call = Call(hashlib.blake2b(question.encode(), digest_size=8).hexdigest(), self.search, {"query": question})
                return Reply(calls=(call,), usage=Usage(max(1, len(question) // 4)))
            return Reply(question and f"{answers.NOTHING} The question was: {question}", usage=Usage(max(1, len(question) // 4)))
        rows = [(0, m.name, m.text) for m in results]
        evidence = answers.parsed_evidence(self.spark.createDataFrame(rows, "query_id long, name string, content string"), (self.search, "search")).persist()
        asked = self.spark.createDataFrame([(0, question)], "query_id long, query string")
        text = answers.cited(asked, evidence.drop("rank")).first()["answer"]
        read = evidence.agg(F.coalesce(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))), F.lit(0)).alias("n")).first()["n"]
        evidence.unpersist()
        return Reply(text, usage=Usage(int(read), max(1, len(text) // 4)))


class HttpService:
    """A hosted model behind HTTP.  ``encode`` makes the body of a request, ``decode`` a reply of the answer's JSON."""

    def __init__(self, name: str, url: str, headers: dict[str, str], encode: Callable[[Request], dict], decode: Callable[[dict], Reply], timeout: float = 60, send: Callable | None = None):
        self.name, self.url, self.headers, self.encode, self.decode, self.timeout = name, url, headers, encode, decode, timeout
        self.send = send or urllib.request.urlopen

    def complete(self, request: Request) -> Reply:
        body = json.dumps(self.encode(request)).encode()
        asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json"} | self.headers)
        try:
            with self.send(asked, timeout=self.timeout) as answer:
                return self.decode(json.loads(answer.read()))
        except urllib.error.HTTPError as e:
            raise ProviderError(f"{self.name} answered {e.code}", e.code, e.code == 429 or e.code >= 500) from e
        except OSError as e:
            raise ProviderError(f"{self.name} cannot be reached: {e}", None, True) from e


def chat_body(model: str) -> Callable[[Request], dict]:
    """The body of a chat completion: roles, function calls and their results."""

    def message(m: Message) -> dict:
        out: dict = {"role": m.role, "content": m.text}
        if m.calls:
            out["tool_calls"] = [{"id": c.id, "type": "function", "function": {"name": c.name, "arguments": json.dumps(c.arguments)}} for c in m.calls]
        return out | ({"tool_call_id": m.call_id} if m.role == "tool" else {})

    def body(r: Request) -> dict:
        tools = [{"type": "function", "function": {k: t[k] for k in ("name", "description", "parameters")}} for t in r.tools.values()]
        return {"model": model, "messages": [message(m) for m in r.messages]} | ({"tools": tools} if tools else {})

    return body


def chat_reply(answer: dict) -> Reply:
    said, used = answer["choices"][0]["message"], answer.get("usage", {})
    calls = tuple(Call(c["id"], c["function"]["name"], json.loads(c["function"]["arguments"] or "{}")) for c in said.get("tool_calls") or ())
    return Reply(said.get("content") or "", calls, Usage(used.get("prompt_tokens", 0), used.get("completion_tokens", 0)))


def block_body(model: str, most: int = 4096) -> Callable[[Request], dict]:
    """The body of a message made of content blocks; every call must have its result before the next message."""

    def blocks(m: Message) -> dict:
        if m.role == "tool":
            return {"role": "user", "content": [{"type": "tool_result", "tool_use_id": m.call_id, "content": m.text, "is_error": m.is_error}]}
        text = [{"type": "text", "text": m.text}] if m.text else []
        return {"role": m.role, "content": text + [{"type": "tool_use", "id": c.id, "name": c.name, "input": c.arguments} for c in m.calls]}

    def body(r: Request) -> dict:
        open_ = {c.id for m in r.messages for c in m.calls} - {m.call_id for m in r.messages if m.role == "tool"}
        if open_:
            raise ProviderError(f"calls without a result: {sorted(open_)}")
        tools = [{"name": t["name"], "description": t["description"], "input_schema": t["parameters"]} for t in r.tools.values()]
        system = "\n\n".join(m.text for m in r.messages if m.role == "system")
        out = {"model": model, "max_tokens": most, "messages": [blocks(m) for m in r.messages if m.role != "system"]}
        return out | ({"system": system} if system else {}) | ({"tools": tools} if tools else {})

    return body


def block_reply(answer: dict) -> Reply:
    by = lambda kind: [b for b in answer["content"] if b["type"] == kind]
    used = answer.get("usage", {})
    calls = tuple(Call(b["id"], b["name"], b["input"]) for b in by("tool_use"))
    return Reply("".join(b["text"] for b in by("text")), calls, Usage(used.get("input_tokens", 0), used.get("output_tokens", 0)), answer.get("stop_reason") == "pause_turn")


class Providers:
    """Factories by name; ``get("name:model")`` makes one."""

    def __init__(self):
        self.factories: dict[str, Callable[..., Provider]] = {}

    def register(self, name: str, factory: Callable[..., Provider]) -> None:
        self.factories[name.lower()] = factory

    def names(self) -> list[str]:
        return sorted(self.factories)

    def get(self, spec: str, **options) -> Provider:
        name, _, model = spec.partition(":")
        if name.lower() not in self.factories:
            raise ProviderError(f"unknown provider {name!r}; there are {', '.join(self.names())}")
        return self.factories[name.lower()](model=model or None, **options)


def default_providers(spark: SparkSession, chat_url: str | None = None, block_url: str | None = None, key: Callable[[str], str | None] = lambda name: None) -> Providers:
    """The extractive provider, and a chat and a block service where their addresses are given."""
    out = Providers()
    out.register("offline", lambda model=None: Extractive(spark))
    for name, url, body, reply in (("chat", chat_url, chat_body, chat_reply), ("blocks", block_url, block_body, block_reply)):
        if url:
            token = key(name)
            out.register(name, lambda model=None, url=url, body=body, reply=reply, name=name, token=token: HttpService(name, url, {"Authorization": f"Bearer {token}"} if token else {}, body(model or "default"), reply))
    return out


def total(replies: Sequence[Reply]) -> Usage:
    return sum((r.usage for r in replies), Usage())
