import json
import threading
import urllib.error
import urllib.request

import pytest

from scriptorium import server
from scriptorium.functions import markup
from scriptorium.operators import answers

HIT = {"id": "c", "title": "T", "chapter": 2, "section": "2.1", "page_url": "https://x/t.html", "lang": "cs", "body": "text", "rerank_score": 0.12345, "score": 0.033333}


class Engine:
    """Stands in for an engine: it records the queries."""

    corpus, asked = "", []

    def language(self, query):
        return query.lang or "cs"

    def search(self, query):
        self.asked.append(query)
        return [HIT][: query.top_k]

    sources = staticmethod(lambda hits, bodies=False: server.Engine.sources(None, hits, bodies))

    def info(self):
        return {"chunks": 1}

    def answer(self, query, history):
        if query.question == "bad":
            raise ValueError("no")
        return {"question": query.question, "history": history}

    def stream(self, query, history):
        def tokens():
            yield "a"
            if query.question == "bad":
                raise RuntimeError("gone")

        yield from answers.stream({"cached": False}, self.sources(self.search(query)), tokens(), {"total": 1.234})


class Engines:
    root = "/none"

    def available(self):
        return ["", "kniha"]

    def get(self, name=""):
        if name not in self.available():
            raise FileNotFoundError(f"no index of corpus {name!r}")
        return Engine()

    def clear(self):
        return 2


@pytest.fixture
def service():
    return server.Service(Engines())


def ask(service, **body):
    return service.respond("POST", "/api/ask", {}, json.dumps(body).encode())


def test_search_clamps_and_gives_bodies(service):
    got = service.respond("GET", "/api/search?q=%20plot%20&k=500&rerank=true&edition=all")
    assert got.status == 200 and got.body["hits"][0] == {"n": 1, "title": "T", "chapter": 2, "section": "2.1", "url": "https://x/t.html", "lang": "cs", "book": None, "rerank": 0.123, "score": 0.0333, "body": "text"}
    query = Engine.asked[-1]
    assert (query.question, query.top_k, query.rerank, query.editions) == ("plot", 50, True, ("full", "demo"))
    assert service.respond("GET", "/api/search?q=x&k=-3").status == 200 and Engine.asked[-1].top_k == 1


@pytest.mark.parametrize("target, status", [("/api/search", 422), ("/api/search?q=x&k=z", 422), ("/api/search?q=x&lang=de", 422), ("/api/search?q=x&corpus=zz", 404), ("/api/nothing", 404), ("/api/search?q=%20", 400)])
def test_refusals_of_a_search(service, target, status):
    got = service.respond("GET", target)
    assert got.status == status and got.body["error"]


def test_refusals_of_a_question(service):
    assert ask(service, question="x", k=51).status == ask(service, question="").status == ask(service, question="x", history=[{"role": "system", "content": ""}]).status == 422
    assert ask(service).status == service.respond("POST", "/api/ask", {}, b"{").status == service.respond("POST", "/api/ask", {}, b"[]").status == 422
    assert ask(service, question="bad").status == 400 and ask(service, question="x", corpus="zz").status == 404
    assert ask(service, question="x", history=[{"role": "user", "content": "y"}]).body["history"] == [{"role": "user", "content": "y"}]


def test_frames_in_order(service):
    got = ask(service, question="x", stream=True)
    events = answers.read_frames("".join(got.frames))
    assert [e for e, _ in events] == ["meta", "sources", "token", "done"] and json.loads(events[2][1]) == {"t": "a"} and json.loads(events[3][1]) == {"timings": {"total": 1.23}, "cached": False}
    events = answers.read_frames("".join(service.respond("POST", "/api/ask/stream", {}, b'{"question": "bad"}').frames))
    assert events[-1] == ("error", '{"error": "RuntimeError: gone"}')


def test_token():
    service = server.Service(Engines(), token="s3")
    assert service.respond("GET", "/api/health").body["auth_required"] and service.respond("GET", "/api/corpora").status == 401
    assert service.respond("GET", "/api/corpora").headers == {"WWW-Authenticate": "Bearer"}
    for target, headers, status in (("/api/corpora", {"Authorization": "bEaReR s3"}, 200), ("/api/corpora?token=s3", {}, 200), ("/api/corpora?token=s3", {"Authorization": "Bearer no"}, 401), ("/api/corpora", {"Authorization": "Basic s3"}, 401)):
        assert service.respond("GET", target, headers).status == status, (target, headers)
    assert service.respond("POST", "/api/cache/clear", {"authorization": "Bearer s3"}).body == {"cleared": 2}


def test_health_never_fails(service):
    assert service.respond("GET", "/api/health").body["default"] == {"chunks": 1}
    degraded = server.Service(Engines(), default="zz").respond("GET", "/api/health")
    assert degraded.status == 200 and degraded.body["status"] == "degraded" and "zz" in degraded.body["error"]
    assert [r["name"] for r in service.respond("GET", "/api/corpora").body] == ["", "kniha"]


def test_over_sockets(service):
    http = server.ThreadingHTTPServer(("127.0.0.1", 0), server.handler(service, ["https://a.example"]))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    with urllib.request.urlopen(urllib.request.Request(f"{base}/api/search?q=x", headers={"Origin": "https://a.example"})) as got:
        assert got.headers["Access-Control-Allow-Origin"] == "https://a.example" and json.loads(got.read())["lang"] == "cs"
    with urllib.request.urlopen(urllib.request.Request(f"{base}/api/ask/stream", b'{"question": "x"}')) as got:
        assert got.headers["Content-Type"] == "text/event-stream" and got.read().count(b"event:") == 4
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"{base}/api/search")
    assert e.value.code == 422
    http.shutdown()


def test_markup(spark):
    sources = {1: {"url": "u?a=1&b=2", "title": 'A "b"'}, 2: {"url": None, "title": None}}
    link = '<a class="cite" href="u?a=1&amp;b=2" target="_blank" rel="noopener" title="A &quot;b&quot;">[1]</a>'
    assert markup.html("Viz [1; 9] <b>.", sources) == f"<p>Viz {link}[9] &lt;b&gt;.</p>"
    assert markup.html("## Nadpis\n\n- a **b**\n- `c`\n\n1. x\n2) y", {}) == "<h4>Nadpis</h4><ul><li>a <strong>b</strong></li><li><code>c</code></li></ul><ol><li>x</li><li>y</li></ol>"
    assert markup.html("Text:\n* a\nkonec *i* 2*3*4", {}) == "<p>Text:</p><ul><li>a</li></ul><p>konec <em>i</em> 2*3*4</p>"
    assert markup.html("1. x\nprose", {}) == "<p>1. x</p><p>prose</p>" and markup.html("", {}) == ""
    rows = spark.createDataFrame([(1, "[1]"), (2, None), (3, "[1]")], "qid int, answer string")
    made = {r.qid: r.html for r in answers.rendered(rows, spark.createDataFrame([(1, 1, "u", "t")], "qid int, n int, url string, title string")).collect()}
    assert "href" in made[1] and made[2] is None and made[3] == "<p>[1]</p>"


def test_commands():
    from scriptorium import cli

    for line in ("crawl https://x/ --out o --mirror m", "serve --port 1 --warm a b", "search q --json", "doctor"):
        assert cli.parser().parse_args(line.split()).command == line.split()[0]
    assert cli.table([{"n": 1, "title": "T", "lang": "cs", "chapter": 2, "section": None, "score": 0.5, "url": "u"}]) == "[1] T (cs, ch. 2)  0.5000\n    u"
