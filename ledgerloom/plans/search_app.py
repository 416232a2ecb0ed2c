"""Entity search from the command line, and over HTTP.

``python -m ledgerloom.plans.search_app QUERY --entities PATH --index PATH [--top-k N]`` prints a table;
``--serve PORT`` answers ``GET /health`` and ``GET /search?q=...&top_k=...`` instead.
"""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ledgerloom.operators.entity_index import EntityIndex, build
from ledgerloom.shared import path_exists

MOST_RESULTS = 50
_SHOWN = ("rank", "entity_id", "entity_name", "normalized_name", "country_code", "entity_type", "lei", "rrf_score", "bm25_rank", "vector_rank")


def results(index: EntityIndex, query: str, k: int) -> list[dict]:
    found = [r.asDict() for r in index.search(query, k).collect()]  # k rows at most
    return [{c: (rank if c == "rank" else row[c]) for c in _SHOWN} for rank, row in enumerate(found, 1)]


def answer(index: EntityIndex | None, target: str) -> tuple[int, dict]:
    """Status and body for a request's target."""
    parts = urlsplit(target)
    asked = parse_qs(parts.query)
    if parts.path == "/health":
        return 200, {"status": "ok", "index": "not_loaded" if index is None else "ready"}
    if parts.path != "/search":
        return 404, {"detail": "unknown path"}
    query, count = asked.get("q", [""])[0], asked.get("top_k", ["5"])[0]
    if not query or not count.isdecimal() or not 1 <= int(count) <= MOST_RESULTS:
        return 422, {"detail": f"q must not be empty and top_k must lie from 1 to {MOST_RESULTS}"}
    if index is None:
        return 503, {"detail": "no search index is loaded"}
    found = results(index, query, int(count))
    return 200, {"query": query, "top_k": int(count), "count": len(found), "results": found}


def serve(index: EntityIndex | None, port: int) -> ThreadingHTTPServer:
    """A server bound to this machine; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(index, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def table_text(found: list[dict]) -> str:
    widths = {"rank": 5, "rrf_score": 10, "bm25_rank": 10, "vector_rank": 12, "entity_name": 36, "country_code": 13, "entity_type": 12}
    lines = ["".join(name.ljust(width) for name, width in widths.items())]
    for row in found:
        lines.append("".join(("-" if row[c] is None else str(row[c]))[: width - 1].ljust(width) for c, width in widths.items()))
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    from ledgerloom.session import get_session

    parser = argparse.ArgumentParser(description="Search current entities by keywords and vectors.")
    parser.add_argument("query", nargs="?", default="")
    parser.add_argument("--entities", required=True, help="Parquet table of current entities")
    parser.add_argument("--index", help="folder of the stored index")
    parser.add_argument("--top-k", type=int, default=5)
    parser.add_argument("--serve", type=int, metavar="PORT")
    args = parser.parse_args(argv)
    spark = get_session()
    there = path_exists(spark, args.entities)
    if not there and args.serve is None:
        print(f"no entities at {args.entities}; run the lakehouse first", file=sys.stderr)
        return 1
    index = build(spark.read.parquet(args.entities), args.index)[0] if there else None
    if args.serve is not None:
        serve(index, args.serve).serve_forever()
        return 0
    found = results(index, args.query, args.top_k)
    print(table_text(found) if found else "no results")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
