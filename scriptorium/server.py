"""HTTP over the engines, on the standard library.

``Service.respond`` maps a request to a reply and is all there is to test; ``serve`` puts it behind sockets.
Routes: GET /api/health, /api/corpora, /api/search; POST /api/ask, /api/ask/stream, /api/cache/clear.
Replies are JSON, streamed answers are event frames. Errors: 401 without the token (where one is set; health
needs none), 404 for a corpus without an index or an unknown route, 422 for values that don't fit, 400 for
other bad values, 500 for the rest; an error after a stream has begun is a frame in it.
"""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession

from scriptorium import __version__
from scriptorium.api import Engine, Engines
from scriptorium.model import EDITIONS, LIMITS, MOST_HITS, Query
from scriptorium.sources import records


class Refused(Exception):
    def __init__(self, status: int, said: object, headers: Mapping[str, str] = {}):
        super().__init__(str(said))
        self.status, self.said, self.headers = status, said, dict(headers)


@dataclass
class Reply:
    body: object = None
    status: int = 200
    headers: dict[str, str] = field(default_factory=dict)
    frames: Iterator[str] | None = None


@dataclass(frozen=True)
class Field:
    """A value of a request: what it is when it is missing, and whether one that is there fits."""

    default: object
    fits: Callable[[object], bool]
    says: str


_flag = lambda v: v is None or isinstance(v, bool)
_turns = lambda v: isinstance(v, list) and all(isinstance(t, dict) and t.get("role") in ("user", "assistant") and isinstance(t.get("content"), str) for t in v)
REQUIRED = object()
ASK = {
    "question": Field(REQUIRED, lambda v: isinstance(v, str) and 1 <= len(v) <= 4000, "a text of 1 to 4000 characters"),
    "corpus": Field(None, lambda v: v is None or isinstance(v, str), "a name"),
    "lang": Field(None, lambda v: v in (None, "cs", "en"), "cs or en"),
    "k": Field(LIMITS.top_k, lambda v: isinstance(v, int) and not isinstance(v, bool) and 1 <= v <= MOST_HITS, f"1 to {MOST_HITS}"),
    "edition": Field("full", lambda v: v in (*EDITIONS, "all"), "full, demo or all"),
    "rerank": Field(None, _flag, "true or false"),
    "history": Field([], _turns, "a list of turns with role and content"),
    "stream": Field(False, lambda v: isinstance(v, bool), "true or false"),
}
#: A search takes any whole number for k and brings it into range.
SEARCH = {n: ASK[n] for n in ("corpus", "lang", "edition", "rerank")} | {"q": ASK["question"], "k": Field(LIMITS.top_k, lambda v: isinstance(v, int), "a whole number")}


def checked(given: object, wanted: dict[str, Field]) -> dict:
    """Values by name, defaults filled in; 422 with every value that doesn't fit."""
    if not isinstance(given, dict):
        raise Refused(422, "an object is expected")
    out = {n: given.get(n, f.default) for n, f in wanted.items()}
    wrong = {n: wanted[n].says for n, v in out.items() if v is REQUIRED or not wanted[n].fits(v)}
    if wrong:
        raise Refused(422, "; ".join(f"{n}: {s}" for n, s in wrong.items()))
    return out


def typed(given: dict[str, str]) -> dict:
    """Values of a query string as what they stand for."""
    out: dict[str, object] = dict(given)
    if "k" in out:
        try:
            out["k"] = int(given["k"])
        except ValueError:
            pass
    if "rerank" in out:
        out["rerank"] = {"true": True, "1": True, "false": False, "0": False, "": None}.get(given["rerank"].lower(), given["rerank"])
    return out


def bearer(header: str) -> str | None:
    """The token of an authorization header."""
    scheme, _, token = header.partition(" ")
    return token if scheme.lower() == "bearer" else None


class Service:
    """Replies to requests. ``token`` empty means that none is asked for; ``default`` is the corpus of requests that name none."""

    def __init__(self, engines: Engines, token: str = "", default: str = ""):
        self.engines, self.token, self.default = engines, token, default
        self.routes: dict[tuple[str, str], Callable[[dict, object], Reply]] = {
            ("GET", "/api/corpora"): self.corpora, ("GET", "/api/search"): self.search, ("POST", "/api/ask"): self.ask,
            ("POST", "/api/ask/stream"): lambda q, body: self.streamed(checked(body, ASK)), ("POST", "/api/cache/clear"): lambda q, body: Reply({"cleared": self.engines.clear()}),
        }

    def respond(self, method: str, target: str, headers: Mapping[str, str] = {}, body: bytes = b"") -> Reply:
        url = urlsplit(target)
        asked = dict(parse_qsl(url.query, keep_blank_values=True))
        try:
            if (method, url.path) == ("GET", "/api/health"):
                return self.health()
            if url.path.startswith("/api/"):
                self.admit({k.lower(): v for k, v in headers.items()}.get("authorization", ""), asked)
            route = self.routes.get((method, url.path))
            if route is None:
                raise Refused(404, "no such route")
            try:
                said = json.loads(body) if body else {}
            except ValueError:
                raise Refused(422, "the body is no JSON") from None
            return route(asked, said)
        except Refused as e:
            return Reply({"error": e.said}, e.status, e.headers)
        except Exception as e:  # every failure is a reply
            status = next((s for kind, s in ((FileNotFoundError, 404), (ValueError, 400)) if isinstance(e, kind)), 500)
            return Reply({"error": f"{type(e).__name__}: {e}"}, status)

    def admit(self, header: str, asked: dict[str, str]) -> None:
        given = bearer(header)
        if self.token and not hmac.compare_digest((asked.get("token", "") if given is None else given).encode(), self.token.encode()):
            raise Refused(401, "this needs a valid token", {"WWW-Authenticate": "Bearer"})

    def engine(self, name: str | None) -> Engine:
        return self.engines.get(self.default if name is None else name)

    def health(self) -> Reply:
        """Always 200: a part that fails is in the reply."""
        out = {"status": "ok", "version": __version__, "auth_required": bool(self.token), "corpora": [], "default_corpus": self.default, "default": None}
        try:
            out["corpora"] = self.engines.available()
            out["default"] = self.engine(None).info()
        except Exception as e:
            out |= {"status": "degraded", "error": str(e)}
        return Reply(out)

    def corpora(self, asked: dict, body: object) -> Reply:
        rows = []
        for name in self.engines.available():
            known = records.corpus_row(self.engines.root, name)
            rows.append({"name": name, "label": name or "textbook", "chunks": known.get("n_chunks"), "books": known.get("books", [])})
        return Reply(rows)

    def search(self, asked: dict, body: object) -> Reply:
        v = checked(typed(asked), SEARCH)
        engine = self.engine(v["corpus"])
        query = Query(v["q"].strip(), max(1, min(v["k"], MOST_HITS)), v["lang"], v["edition"], v["rerank"])
        return Reply({"lang": engine.language(query), "corpus": engine.corpus or "textbook", "hits": engine.sources(engine.search(query), bodies=True)})

    def ask(self, asked: dict, body: object) -> Reply:
        v = checked(body, ASK)
        return self.streamed(v) if v["stream"] else Reply(self.engine(v["corpus"]).answer(self.query(v), v["history"]))

    def streamed(self, v: dict) -> Reply:
        engine, query = self.engine(v["corpus"]), self.query(v)

        def frames() -> Iterator[str]:
            try:
                yield from engine.stream(query, v["history"])
            except Exception as e:  # the status has gone out already
                yield f"event: error\ndata: {json.dumps({'error': f'{type(e).__name__}: {e}'}, ensure_ascii=False)}\n\n"

        return Reply(headers={"Content-Type": "text/event-stream", "Cache-Control": "no-cache", "X-Accel-Buffering": "no"}, frames=frames())

    @staticmethod
    def query(v: dict) -> Query:
        return Query(v["question"].strip(), v["k"], v["lang"], v["edition"], v["rerank"])


def handler(service: Service, origins: Iterable[str] = ("*",)) -> type[BaseHTTPRequestHandler]:
    allowed = set(origins)

    class Handler(BaseHTTPRequestHandler):
        def origin(self) -> str | None:
            asked = self.headers.get("Origin")
            return "*" if "*" in allowed else asked if asked in allowed else None

        def reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            got = service.respond(self.command, self.path, self.headers, body)
            raw = None if got.frames is not None else json.dumps(got.body, ensure_ascii=False).encode()
            self.send_response(got.status)
            extra = {"Access-Control-Allow-Origin": self.origin()} | ({"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(raw))} if raw is not None else {"Connection": "close"})
            for name, value in (extra | got.headers).items():
                if value is not None:
                    self.send_header(name, value)
            self.end_headers()
            for part in [raw] if raw is not None else (f.encode() for f in got.frames):
                self.wfile.write(part)
                self.wfile.flush()

        do_GET = do_POST = reply

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for name, value in (("Access-Control-Allow-Origin", self.origin()), ("Access-Control-Allow-Methods", "*"), ("Access-Control-Allow-Headers", "*")):
                if value:
                    self.send_header(name, value)
            self.end_headers()

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def server(spark: SparkSession, root: str, host: str = "127.0.0.1", port: int = 8000, token: str = "", origins: Iterable[str] = ("*",), default: str = "", **options) -> ThreadingHTTPServer:
    """A server that ``serve_forever`` starts; a thread per request, Spark schedules what they ask for."""
    return ThreadingHTTPServer((host, port), handler(Service(Engines(spark, root, **options), token, default), origins))
