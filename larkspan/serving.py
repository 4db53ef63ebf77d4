"""A small server: uploads into the readings, their statistics, and a stored suggestions document, whose bytes are sent as they
are, with a strong tag."""

from __future__ import annotations

import email.utils
import gzip
import hashlib
import json
import os
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def respond(path: str, if_none_match: str | None = None, if_modified_since: str | None = None) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body: 404 without a file, 500 if it can't be read, 304 if the caller has it; a tag outweighs a date."""
    if not os.path.exists(path):
        return 404, {}, b'{"error": "no_suggestions"}'
    try:
        with open(path, "rb") as f:
            body = f.read()
        json.loads(body)
        changed = os.path.getmtime(path)
    except (OSError, ValueError):
        return 500, {}, b'{"error": "unreadable"}'
    tag = f'"{hashlib.md5(body, usedforsecurity=False).hexdigest()}"'
    head = {"ETag": tag, "Last-Modified": email.utils.formatdate(changed, usegmt=True), "Content-Type": "application/geo+json"}
    if if_none_match is not None:
        known = [t.strip().removeprefix("W/") for t in if_none_match.split(",")]
        if tag in known or "*" in known:
            return 304, head, b""
    elif if_modified_since is not None:
        try:
            since = email.utils.parsedate_to_datetime(if_modified_since).timestamp()
        except (TypeError, ValueError):
            since = None
        if since is not None and int(changed) <= since:
            return 304, head, b""
    return 200, head, body


def upload(spark, table: str, body: bytes, encoding: str | None = None) -> tuple[int, dict]:
    """Status and answer for a posted document: counts, or why it is refused as a whole."""
    from pyspark.sql import functions as F

    from larkspan.sources import batches
    from larkspan.streaming.ingest import append_new

    try:
        text = (gzip.decompress(body) if (encoding or "").lower() == "gzip" else body).decode()
    except (OSError, EOFError, zlib.error, UnicodeDecodeError):
        return 400, {"error": "invalid_json"}
    samples = batches.parsed(spark.createDataFrame([("upload", text)], "batch string, body string")).persist()
    try:
        found = batches.verdicts(samples).select("errors").first()[0]
        for whole in ("invalid_json", "batch_too_large"):
            if whole in found:
                return 400, {"error": whole}
        if found:
            faulty = samples.where(F.size("errors") > 0).orderBy("pos").select("pos", "errors").collect()  # of one batch
            return 400, {"error": "validation_error", "detail": [{"sample": r[0], "fields": r[1]} for r in faulty]}
        with _store:
            return 200, append_new(spark, batches.accepted(samples), table)
    finally:
        samples.unpersist()


def statistics(spark, table: str) -> dict:
    """Totals, re-reads and sessions of the stored readings, as the ``stats`` command has them."""
    from larkspan.operators import readings
    from larkspan.sinks.documents import clean

    rows = spark.read.parquet(table)
    return clean({"totals": readings.totals(rows).first().asDict(), "rereads": readings.rereads(rows).first().asDict(), "sessions": [r.asDict() for r in readings.per_session(rows).orderBy("started_at").toLocalIterator()]})


#: Keys are compared with the stored ones and appended by one upload at a time.
_store = threading.Lock()


def answer(method: str, path: str, headers, body: bytes, suggestions: str, spark=None, table: str | None = None) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body for a request; without a session only suggestions are served."""
    as_json = lambda status, value: (status, {}, json.dumps(value, default=str).encode())
    if (method, path) == ("GET", "/healthz"):
        return as_json(200, {"status": "ok"}) if spark is None or not spark.sparkContext._jsc.sc().isStopped() else as_json(503, {"status": "unavailable"})
    if (method, path) == ("GET", "/v1/suggestions"):
        return respond(suggestions, headers.get("If-None-Match"), headers.get("If-Modified-Since"))
    if spark is not None and table and (method, path) == ("POST", "/v1/measurements"):
        return as_json(*upload(spark, table, body, headers.get("Content-Encoding")))
    if spark is not None and table and (method, path) == ("GET", "/v1/stats"):
        return as_json(200, statistics(spark, table))
    return as_json(404, {"error": "not_found"})


def serve(path: str, port: int, spark=None, table: str | None = None) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, head, body = answer(self.command, self.path.split("?")[0], self.headers, body, path, spark, table)
            self.send_response(status)
            for k, v in ({"Content-Type": "application/json"} | head).items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _answer

    ThreadingHTTPServer(("", port), Handler).serve_forever()
