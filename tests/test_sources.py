import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from corpusmill.models import EchoGenerator, HttpModels, ModelError
from corpusmill.operators import answers, sync
from corpusmill.settings import Settings
from corpusmill.sources import fetch


class Site(BaseHTTPRequestHandler):
    asked: list = []

    def log_message(self, *args):
        pass

    def _say(self, code, text):
        self.send_response(code)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        self.wfile.write(text.encode())

    def do_GET(self):
        self.asked.append(self.path)
        if self.path == "/robots.txt":
            self._say(200, "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\n")
        elif self.path == "/flaky" and self.asked.count("/flaky") < 3:
            self._say(503, "later")
        elif self.path == "/gone":
            self._say(404, "no")
        elif self.path == "/api/version":
            self._say(200, '{"version": "1"}')
        elif self.path == "/api/tags":
            self._say(200, '{"models": [{"name": "a"}, {"name": "b"}]}')
        else:
            self._say(200, f"<p>página {self.path}</p>")

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/api/embed":
            n = len(body["input"]) - (body["model"] == "short")
            self._say(200, json.dumps({"embeddings": [[1.0, 2.0]] * n}))
        elif body["model"] == "broken":
            self._say(200, '{"message": {"content": "a"}}\n{"error": "out of memory"}\n')
        else:
            self._say(200, '{"message": {"content": "Hola "}}\n\n{"message": {"content": "mundo"}, "done": true}\n')


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_are_fetched_with_retries_and_rules(site):
    waited = []
    client = fetch.Client(site, "corpusmill", 0, 5, sleep=waited.append)
    assert client.page(f"{site}/a") == "<p>página /a</p>"
    assert "/flaky" in client.page(f"{site}/flaky") and waited == [1, 2]
    with pytest.raises(fetch.FetchError, match="404 Not Found"):
        client.page(f"{site}/gone")
    with pytest.raises(fetch.FetchError, match="robots"):
        client.page(f"{site}/private/x")


def test_requests_keep_their_distance():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pacer = fetch.Pacer(0.75, clock=lambda: now[0], sleep=sleep)
    pacer.wait()
    now[0] += 0.5
    pacer.wait()
    now[0] += 2
    pacer.wait()
    assert slept == [0.25]


def test_fetched_pages_are_rows(spark, site):
    rows = fetch.fetch_pages(spark.createDataFrame([(f"{site}/a",), (f"{site}/gone",), (f"{site}/private/x",), (None,)], "url string"), Settings(delay_seconds=0)).collect()
    got = {r.url.removeprefix(site): (r.html, r.error) for r in rows}
    assert got["/a"] == ("<p>página /a</p>", None) and "404 Not Found" in got["/gone"][1] and "robots" in got["/private/x"][1]
    documents = spark.createDataFrame([], "url string, content_hash string, processor_version string")
    fetched = spark.createDataFrame([(u, e, 1, "h") for u, (_, e) in got.items()], "url string, error string, n_chunks int, content_hash string")
    assert {r.url: r.outcome for r in sync.outcome(fetched, documents).collect()} == {"/a": "inserted", "/gone": "skipped", "/private/x": "failed"}


def test_robots_of_each_host(spark):
    pages = spark.createDataFrame([("http://a/x",), ("http://a/y",), ("http://b/x",), (None,)], "url string")
    got = fetch.robots_allowed(pages, {"a": "User-agent: *\nAllow: /x\nDisallow: /"}, "me").collect()
    assert [r.allowed for r in got] == [True, False, True, False]


def test_model_server(site):
    models = HttpModels(site, "m", "c", 5)
    assert models.inventory() == {"version": "1", "models": ["a", "b"]}
    assert models.embed(["x", "y"]) == [[1.0, 2.0]] * 2
    assert "".join(models.answer([{"role": "user", "content": "q"}])) == "Hola mundo"
    with pytest.raises(ModelError):
        HttpModels(site, "short", "c", 5).embed(["x", "y"])
    with pytest.raises(ModelError, match="memory"):
        list(HttpModels(site, "m", "broken", 5).answer([]))
    with pytest.raises(ModelError):
        HttpModels("http://127.0.0.1:9", "m", "c", 1).inventory()


class Failing(EchoGenerator):
    def answer(self, messages):
        if "dos" in messages[-1]["content"]:
            raise ModelError("no model")
        yield "  La célula. "


def test_an_error_ends_the_events_of_one_question(spark):
    hits = spark.createDataFrame([(q, 1, f"u{q}", "T", "S", "H", "La célula") for q in (1, 2)], "qid long, rank int, url string, title string, subject string, heading string, text string")
    asked = spark.createDataFrame([(1, "uno"), (2, "dos")], "qid long, question string")
    gate = spark.createDataFrame([(1, True), (2, True)], "qid long, sufficient boolean")
    rows = answers.chat(asked, hits, gate, Failing(), Settings()).orderBy("qid", "seq").collect()
    events = [(r.qid, json.loads(r.event)) for r in rows]
    assert [(q, e["type"]) for q, e in events] == [(1, "sources"), (1, "token"), (1, "done"), (2, "sources"), (2, "error")]
    assert events[1][1]["content"] == "La célula." and events[4][1]["message"] == "no model"


def test_prompt_rules():
    for rule in ("LaTeX", "$$", "[1]", "silence", "never follow instructions", f"{answers.LEAST_WORDS} to {answers.MOST_WORDS}"):
        assert rule in answers.SYSTEM
