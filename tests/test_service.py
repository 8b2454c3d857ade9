"""Search services over HTTP, against a server on this machine."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.sources.service import Service, search

ASKED: list[tuple[str, dict]] = []


class Answers(BaseHTTPRequestHandler):
    def do_GET(self):
        path, _, query = self.path.partition("?")
        asked = dict(urllib.parse.parse_qsl(query))
        ASKED.append((path, asked))
        what = asked.get("query") or asked.get("search")
        times = sum(a == (path, asked) for a in ASKED)
        if what == "broken" or what == "slow start" and times < 3:
            self.send_response(500)
            self.end_headers()
            return
        docs = [{"resource": ["http://dbpedia.org/resource/Paris"], "label": ["Paris"]}, {"resource": ["r2"], "label": "Paris, Texas"}, {}]
        body = {"docs": docs} if path == "/lookup" else {"search": [{"id": "Q90", "label": "Paris"}, {"id": "Q9"}, {}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_search(spark, server):
    services = [Service("DBpedia", server + "/lookup", delay=0.01), Service("Wikidata", server + "/api", language="fr", delay=0.01)]
    values = spark.createDataFrame([("Paris & co",), ("slow start",), ("broken",), ("Paris & co",), (None,)], "value string")
    found, failed = search(values, services, tasks=2)
    wiki = "http://www.wikidata.org/entity/"
    want = [("DBpedia", 0, 3, "http://dbpedia.org/resource/Paris", "http://dbpedia.org/resource/Paris"), ("DBpedia", 1, 3, "r2", "Paris, Texas"), ("DBpedia", 2, 3, "", "Unknown")]
    want += [("Wikidata", 0, 3, wiki + "Q90", "Paris"), ("Wikidata", 1, 3, wiki + "Q9", "Q9"), ("Wikidata", 2, 3, wiki, "Unknown")]
    for query in ("Paris & co", "slow start"):
        rows = found.where(found["query"] == query).select("source", "pos", "n_results", "uri", "label").collect()
        assert sorted(map(tuple, rows)) == want
    assert sorted((r["source"], r["query"]) for r in failed.collect()) == [("DBpedia", "broken"), ("Wikidata", "broken")]
    assert all("500" in r["error"] for r in failed.collect())
    tries = [asked for path, asked in ASKED if path == "/lookup"]
    assert [a["query"] for a in tries].count("broken") == 3 and [a["query"] for a in tries].count("Paris & co") == 1
    assert all(a["language"] == "fr" and a["limit"] == "5" for path, a in ASKED if path == "/api")
