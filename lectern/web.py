"""A search service over HTTP: GET /search?q=...&mode=classe|booleen gives JSON.

A page of results at a time comes to the driver: `limit` rows of them, from the best on.
"""

from __future__ import annotations

import json
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlsplit

from lectern.plans.search import SearchService

MODES = ("classe", "booleen")
SHOWN = ("doc_id", "score", "titre", "rubrique", "date", "article", "auteur")


def found(service: SearchService, question: str, mode: str, limit: int) -> dict:
    """The answer to a question: its best rows, and what a correction changed."""
    rows = service.run(question, mode)
    best = rows.select(*[c for c in SHOWN if c in rows.columns]).limit(limit).collect()
    return {"question": question, "mode": mode, "hint": service.hint(question), "results": [r.asDict() for r in best]}


def server(service: SearchService, host: str = "127.0.0.1", port: int = 0, limit: int = 20) -> ThreadingHTTPServer:
    """A server that answers when serve_forever() is called; port 0 is any free one."""
    one_at_a_time = Lock()  # the service remembers its last correction

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            wanted = {k: v[0] for k, v in parse_qs(url.query).items()}
            mode = wanted.get("mode", MODES[0])
            if url.path != "/search":
                self.reply(HTTPStatus.NOT_FOUND, {"error": "only /search"})
            elif not wanted.get("q") or mode not in MODES:
                self.reply(HTTPStatus.BAD_REQUEST, {"error": "q is missing, or mode is neither classe nor booleen"})
            else:
                with one_at_a_time:
                    answer = found(service, wanted["q"], mode, limit)
                self.reply(HTTPStatus.OK, answer)

        def reply(self, status: HTTPStatus, answer: dict) -> None:
            body = json.dumps(answer, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, format: str, *args: object) -> None:  # noqa: A002
            pass

    return ThreadingHTTPServer((host, port), Handler)
