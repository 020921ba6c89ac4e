"""The meta-search source against a service on this machine."""

from __future__ import annotations

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

from recallbase.sources import websearch


class Service(BaseHTTPRequestHandler):
    def do_GET(self):
        q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["q"][0]
        results = [] if q == "none" else [{"title": f"{q} {i}", "url": f"https://x/{i}", "score": 1 / (i + 1)} for i in range(5)] + [{"title": "no", "url": "ftp://x"}]
        body = json.dumps({"results": results}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_results_per_query(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = websearch.search(spark, f"http://127.0.0.1:{server.server_port}/", ["ä & b", "none", "c"], most=3).collect()
    finally:
        server.shutdown()
    assert sorted((r.query, r.place, r.url) for r in rows) == [(q, i + 1, f"https://x/{i}") for q in ("c", "ä & b") for i in range(3)]
