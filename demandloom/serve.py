"""Read-only HTTP API over a dataset's metadata: /health and /metadata."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

#: What is told when there is no readable metadata.
UNKNOWN = {"dataset_version": "unavailable", "profile": "unknown", "quality_status": "unavailable", "series_count": 0, "row_count": 0}


def health() -> dict[str, Any]:
    return {"status": "ok", "time": datetime.now(UTC).isoformat()}


def metadata(path: str | Path) -> dict[str, Any]:
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        found = {}
    return {k: found.get(k, v) for k, v in UNKNOWN.items()}


def server(path: str | Path, port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            told = {"/health": health, "/metadata": lambda: metadata(path)}.get(self.path)
            body = json.dumps(told() if told else {"error": "not found"}).encode()
            self.send_response(200 if told else 404)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
