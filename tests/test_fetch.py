import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from bundlelens import job
from bundlelens.operators import chunks
from bundlelens.sources import fetch


class Site(BaseHTTPRequestHandler):
    tries: dict[str, int] = {}
    asked: dict[str, dict[str, str]] = {}

    def do_GET(self):
        self.asked[self.path] = {k.lower(): v for k, v in self.headers.items()}
        n = self.tries[self.path] = self.tries.get(self.path, 0) + 1
        status = {"/moved": 302, "/loop": 302, "/none": 404}.get(self.path, 503 if self.path == "/flaky" and n == 1 else 200)
        body = b"x" * 5000 if self.path == "/large" else "<p>é</p>".encode()
        self.send_response(status)
        if self.path == "/moved":
            self.send_header("Set-Cookie", "seen=1; Path=/")
        if status == 302:
            self.send_header("Location", "/loop" if self.path == "/loop" else "/")
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_capture(spark, site):
    spark.dataSource.register(fetch.Capture)
    urls = " ".join(f"{site}/{p}" for p in ("", "moved", "none", "flaky", "large", "loop")) + " http://127.0.0.1:1/"
    rows = spark.read.format("capture").options(urls=urls, concurrency="3", max_bytes="1000", retries="1").load().collect()
    by = {}
    for r in rows:
        by.setdefault(r.url.removeprefix(site), []).append(r)
    assert {r.status for r in by["/"]} == {200} and by["/"][0].body == "<p>é</p>" and by["/"][0].size == 9
    assert by["/moved"][0].redirect_to == f"{site}/" and by["/none"][0].error == "HTTP 404" and by["/flaky"][0].status == 200
    assert by["/large"][0].error == "too large" and by["/large"][0].body is None
    assert len(by["/loop"]) == 11 and by["http://127.0.0.1:1/"][0].status is None and by["http://127.0.0.1:1/"][0].error


def test_requests_look_like_a_browser(site):
    rows = list(fetch.Reader({"urls": f"{site}/moved"}).read(fetch.Part([f"{site}/moved"])))
    assert [r[1] for r in rows] == [302, 200]
    first, second = Site.asked["/moved"], Site.asked["/"]
    assert (first["sec-fetch-site"], second["sec-fetch-site"]) == ("none", "same-origin") and first["sec-fetch-dest"] == "document" and "Chrome" in first["user-agent"]
    assert "cookie" not in first and second["cookie"] == "seen=1"


def test_job_captures(spark, site):
    tables = job.run(spark, job.parse_options([f"{site}/,{site}/large,{site}/none", "--out", "x", "--max-bytes", "1000", "--retries", "0"]))
    assert {(r.url.removeprefix(site), r.issue) for r in tables["issues"].collect()} == {("/large", "too large")}
    assert tables["adapters"].count() == 2


def test_refuses_other_schemes():
    with pytest.raises(ValueError):
        fetch.Reader({"urls": "file:///etc/passwd"})


def test_markup(spark):
    mods = spark.createDataFrame([("m", 'a=jsx("b",{children:"x"})'), ("n", "x()")], "id string, code string")
    assert [(r.id, r.jsx, r.template) for r in chunks.markup(mods, ["id"]).collect()] == [("m", "a = <b>x</b>;\n", None)]
