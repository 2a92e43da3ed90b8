"""HTTP over the engine: POST /write, /delete, /build, /query; GET /health. Errors are {error_type, message}."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from quillspan.engine import HybridEngine
from quillspan.model import OperationError, SearchRequest, ValidationError, invalid, required, status_of
from quillspan.sources import wal
from quillspan.streaming import worker


def _body(raw: bytes) -> dict[str, Any]:
    try:
        out = json.loads(raw)
    except ValueError as error:
        raise ValidationError(f"malformed JSON: {error}") from error
    if not isinstance(out, dict):
        raise ValidationError("the body must be an object")
    return out


def handle(engine: HybridEngine, method: str, path: str, raw: bytes = b"") -> tuple[int, dict[str, Any]]:
    """One request to one response, whatever the transport."""
    try:
        if (method, path) == ("GET", "/health"):
            return engine.health()
        if (method, path) == ("POST", "/write"):
            body = _body(raw)
            operation, payload = wal.documents_from_json(json.dumps(body).encode())
            return 200, engine.ingest(payload) if operation == "ingest" else engine.delete(payload)
        if (method, path) == ("POST", "/delete"):
            ids = _body(raw).get("doc_ids")
            if not isinstance(ids, list):
                raise required("doc_ids")
            return 200, engine.delete(ids)
        if (method, path) == ("POST", "/build"):
            body = _body(raw)
            if not isinstance(body.get("version_id"), int):
                raise required("version_id")
            key = body.get("wal_key")
            if key is not None and not isinstance(key, str):
                raise invalid("wal_key")
            return 200, engine.build(body["version_id"], [key] if key else None)
        if (method, path) == ("POST", "/query"):
            request = SearchRequest.from_json(_body(raw))
            request.validate()  # before an index is needed
            return 200, engine.search(request)
        return 404, {"error_type": "not_found", "message": f"{method} {path}"}
    except ValidationError as error:
        return 400, {"error_type": "validation_error", "message": str(error)}
    except OperationError as error:
        return status_of(error.error_type), {"error_type": error.error_type, "message": str(error)}
    except Exception as error:  # a failed plan
        return 500, {"error_type": "execution_error", "message": str(error).splitlines()[0] if str(error) else repr(error)}


def handle_event(engine: HybridEngine, event: dict[str, Any], method: str = "POST") -> dict[str, Any]:
    """A gateway's event (rawPath, body, isBase64Encoded) to its response."""
    text = event.get("body") or ""
    try:
        raw = base64.b64decode(text, validate=True) if event.get("isBase64Encoded") else text.encode()
    except ValueError as error:
        return {"statusCode": 400, "body": json.dumps({"error_type": "validation_error", "message": f"the body does not decode as base64 ({error})"})}
    status, out = handle(engine, method, event.get("rawPath", ""), raw)
    return {"statusCode": status, "headers": {"content-type": "application/json"}, "body": json.dumps(out, ensure_ascii=False), "isBase64Encoded": False}


def handle_batch(engine: HybridEngine, event: dict[str, Any], warn: Callable[[str], None] = lambda _: None) -> dict[str, Any]:
    """A queue's records (messageId, body with wal_key), each a rebuild; those that failed are named, so that the queue redelivers them alone."""
    failed = []
    for record in event.get("Records", []):
        try:
            worker.rebuild(engine.spark, engine.store, engine.embedder.column, engine.embedder.dim, json.loads(record.get("body") or "")["wal_key"], engine.clock)
        except Exception as error:  # any failure is the record's
            warn(f"record {record['messageId']} failed: {error}")
            failed.append({"itemIdentifier": record["messageId"]})
    return {"batchItemFailures": failed}


def serve(engine: HybridEngine, port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            raw = self.rfile.read(int(self.headers.get("content-length") or 0))
            status, out = handle(engine, self.command, self.path, raw)
            data = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
