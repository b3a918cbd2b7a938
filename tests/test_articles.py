"""Articles from a server on this machine."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from larkspur.sources import articles, corpus


@pytest.fixture
def server():
    """(address, counts of requests by title). Titles tell what happens: "busy" answers 429, then 503, then text; "down" always 500; "gone" has no page."""
    seen, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            title = parse_qs(urlparse(self.path).query)["titles"][0]
            with lock:
                seen[title] += 1
                nth = seen[title]
            status = 500 if "down" in title else {1: 429, 2: 503}.get(nth, 200) if "busy" in title else 403 if title == "forbidden" else 200
            page = {"title": title, "missing": True} if "gone" in title else {"title": title, "extract": f"{title}: {self.headers['User-Agent']} " + "é" * 50}
            body = json.dumps({"query": {"pages": [page]}}).encode() if status == 200 else b"no"
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "0.05")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/w/api.php", seen
    http.shutdown()
    http.server_close()


def source(spark, api, titles, schema=None, **options):
    articles.register(spark)
    r = spark.read.format("articles").options(api=api, titles=json.dumps(titles), wait="0.01", **{k: str(v) for k, v in options.items()})
    return (r.schema(schema) if schema else r).load()


def test_source(spark, server):
    api, seen = server
    titles = ["a b&c", "busy", "gone", None, " ", "语 言"] + [f"t{k}" for k in range(20)]
    df = source(spark, api, titles, partitions=3, agent="tester/1")
    assert df.rdd.getNumPartitions() == 3 and not seen
    rows = {r["title"]: (r["text"], r["status"]) for r in df.collect()}
    assert rows["gone"] == (None, "missing") == rows[None] == rows[" "] and len(rows) == len(titles)
    assert rows["语 言"] == ("语 言: tester/1 " + "é" * 50, "ok") and rows["busy"][1] == "ok" and seen["busy"] == 3
    assert {seen[t] for t in titles if t and t.strip() and t != "busy"} == {1} and None not in seen
    assert source(spark, api, []).count() == 0


def test_asks_only_for_the_columns_of_the_schema(spark, server):
    api, seen = server
    assert [r["title"] for r in source(spark, api, ["x", "down"], "title string", partitions=1).collect()] == ["x", "down"] and not seen
    assert source(spark, api, ["x"], "status string, title string").collect() == [("ok", "x")]
    with pytest.raises(Exception, match="no such columns"):
        source(spark, api, ["x"], "author string").collect()
    with pytest.raises(Exception, match="api"):
        source(spark, "", ["x"]).collect()


def test_failures_raise_or_stay_as_rows(spark, server):
    api, seen = server
    with pytest.raises(Exception, match="HTTP 500"):
        source(spark, api, ["x", "down"], retries=1).collect()
    seen.clear()
    rows = {r["title"]: (r["text"] is not None, r["status"]) for r in source(spark, api, ["down", "x", "forbidden"], retries=2, failures="keep").collect()}
    assert rows == {"down": (False, "failed: HTTP 500"), "x": (True, "ok"), "forbidden": (False, "failed: HTTP 403")}
    assert seen == {"down": 3, "x": 1, "forbidden": 1}
    gone = source(spark, "http://127.0.0.1:9/", ["x"], failures="keep").collect()
    assert gone[0]["text"] is None and gone[0]["status"].startswith("failed: ")


def test_a_table_of_titles_is_asked_for_once(spark, server):
    api, seen = server
    titles = spark.createDataFrame([(t, k) for k, t in enumerate(["a", "a", "busy", "gone", "down", None] + [f"t{k}" for k in range(150)])], "title string, text long")
    rows = articles.read_articles(titles, api, at_once=2, retries=2, wait=0.01, failures="keep")
    assert rows.columns == ["title", "text", "status"] and rows.count() == 155 and rows.where("status = 'ok'").count() == 152
    # What is read again, and what is ingested from it, asks the server for nothing.
    report = corpus.ingest_report(corpus.ingest(rows.selectExpr("title", "text raw"), spark.createDataFrame([("a",)], "title string"), 50)).first()
    assert (report["n_ok"], report["n_miss"]) == (151, 3) and {n for t, n in seen.items() if t not in ("busy", "down")} == {1} and seen["down"] == 3
    assert articles.read_articles(titles.where("false"), api).count() == 0
