"""The engine over HTTP, with the standard library's server."""

from __future__ import annotations

import hmac
import json
import re
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .agent.corpus_tools import corpus_tools, hit
from .agent.loop import Agent
from .agent.providers import Provider
from .engine import MODES, Engine

#: Bytes of a text, of a title, and characters of a query.
TEXT, TITLE, QUERY = 4 << 20, 64 << 10, 8000
SOURCE = re.compile(r"^(?!/)(?!.*(?:\.\.|//|\s))[\w./:@+-]{1,512}$")


class Refused(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Service:
    """What each path does, without the transport: ``handle(method, path, body, token)`` gives (status, JSON or lines of events)."""

    def __init__(self, engine: Engine, provider: Provider, token: str | None = None):
        self.engine, self.provider, self.token = engine, provider, token

    def handle(self, method: str, path: str, body: dict | None = None, token: str | None = None) -> tuple[int, dict | Iterator[str]]:
        paths = {("GET", "/health"): self.health, ("GET", "/stats"): self.stats, ("GET", "/sources"): self.sources, ("POST", "/documents"): self.add, ("POST", "/search"): self.search, ("POST", "/ask"): self.ask, ("POST", "/ask/stream"): self.events}
        try:
            if (method, path) not in paths:
                raise Refused(404, "no such path")
            if self.token and path != "/health" and not hmac.compare_digest(token or "", self.token):
                raise Refused(401, "a valid token is needed")
            return 200, paths[method, path](body or {})
        except Refused as e:
            return e.status, {"error": str(e)}

    def _text(self, body: dict, name: str, most: int, least: int = 1) -> str:
        value = body.get(name, "")
        if not isinstance(value, str) or not least <= len(value.encode()) <= most:
            raise Refused(422, f"{name} must be a text of {least} to {most} bytes")
        return value

    def health(self, _) -> dict:
        return {"status": "ok", "version": self.engine.version}

    def stats(self, _) -> dict:
        return self.engine.store.stats(self.engine.version).first().asDict()

    def sources(self, _) -> dict:
        return {"sources": [r.asDict() for r in self.engine.store.sources(self.engine.version, 200).collect()]}

    def add(self, body: dict) -> dict:
        source = self._text(body, "source", 512)
        if not SOURCE.match(source):
            raise Refused(422, "source must be a plain relative name")
        title = self._text(body, "title", TITLE, 0) or None
        found = self.engine.store.add_text(source, self._text(body, "content", TEXT), title)
        return {"id": found, "version": self.engine.refresh()}

    def search(self, body: dict) -> dict:
        query, top_k, mode = self._text(body, "query", QUERY), body.get("top_k", 5), body.get("mode", "hybrid")
        if not isinstance(top_k, int) or isinstance(top_k, bool) or not 1 <= top_k <= 100 or mode not in MODES:
            raise Refused(422, f"top_k must be 1 to 100 and mode one of {MODES}")
        rows = self.engine.search(query, top_k, mode, body.get("source_filter")).orderBy("rank").collect()
        return {"query": query, "count": len(rows), "results": [hit(r) for r in rows]}

    def _agent(self) -> Agent:
        return Agent(self.provider, corpus_tools(self.engine))

    def ask(self, body: dict) -> dict:
        return self._agent().run(self._text(body, "query", QUERY)).as_dict()

    def events(self, body: dict) -> Iterator[str]:
        query = self._text(body, "query", QUERY)
        return (f"event: {e.kind}\ndata: {json.dumps({'text': e.text, 'tool': e.call and e.call.name})}\n\n" for e in self._agent().stream(query))


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready; ``serve_forever()`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, out, body = 413, {"error": "the body is too long"}, None
            if size <= 2 * TEXT:
                try:
                    body = json.loads(self.rfile.read(size) or b"{}") if size else {}
                    assert isinstance(body, dict)
                    status, out = service.handle(self.command, self.path.partition("?")[0], body, (self.headers.get("Authorization") or "").removeprefix("Bearer "))
                except (ValueError, AssertionError):
                    status, out = 422, {"error": "the body must be a JSON object"}
            events = not isinstance(out, dict)
            self.send_response(status)
            self.send_header("Content-Type", "text/event-stream" if events else "application/json")
            self.end_headers()
            for piece in out if events else [json.dumps(out, default=str)]:
                self.wfile.write(piece.encode())

        do_GET = do_POST = _do  # noqa: N815

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
