"""Collections over HTTP: JSON in, JSON out, POST only."""

from __future__ import annotations

import datetime
import hmac
import itertools
import json
import logging
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from foliant.errors import CompileError, DocumentError
from foliant.sources import Database

MAX_BODY = 16 * 1024 * 1024
FIRST_BATCH = 101
LOOPBACK = ("127.0.0.1", "localhost", "::1")


class Refused(Exception):
    def __init__(self, status: int, message: str):
        self.status, self.message = status, message


class Service:
    """The actions behind the routes. A lock keeps changes one at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.databases: dict[str, Database] = {}
        self.lock = threading.Lock()
        self.cursors: dict[str, tuple[str, str, int]] = {}
        self._numbers = itertools.count(1)  # a cursor's number is never given again
        self.actions: dict[str, Callable[[str, str, dict], Any]] = {
            "insert": self.insert, "find": self.find, "update": self.update, "delete": self.delete, "aggregate": self.aggregate,
            "indexes/create": self.create_index, "indexes/drop": self.drop_index, "indexes/list": self.list_indexes,
        }

    def database(self, name: str) -> Database:
        if name not in self.databases:
            self.databases[name] = Database(self.spark, f"{self.root}/{name.encode('utf-8').hex()}")
        return self.databases[name]

    def insert(self, db: str, name: str, body: dict) -> Any:
        return {"insertedCount": self.database(db).collection(name).insert_many(body.get("documents") or [])}

    def _first(self, db: str, name: str, cursor: Any, body: dict) -> Any:
        key, batch = self.database(db).open_cursor(name, cursor.batch_size(body.get("batchSize", FIRST_BATCH)))
        public = "0"
        if key:
            public = str(next(self._numbers))
            self.cursors[public] = (db, name, key)
        return {"batch": batch, "cursorId": public}

    def find(self, db: str, name: str, body: dict) -> Any:
        cursor = self.database(db).collection(name).find(body.get("filter") or {}).sort(body.get("sort") or {}).skip(body.get("skip") or 0).limit(body.get("limit") or 0)
        return self._first(db, name, cursor.project(body["projection"]) if body.get("projection") else cursor, body)

    def aggregate(self, db: str, name: str, body: dict) -> Any:
        return self._first(db, name, self.database(db).collection(name).aggregate(body.get("pipeline") or []), body)

    def update(self, db: str, name: str, body: dict) -> Any:
        c = self.database(db).collection(name)
        done = (c.update_many if body.get("multi") else c.update_one)(body.get("filter") or {}, body.get("update") or {}, upsert=bool(body.get("upsert")))
        return {"matched": done["matched"], "modified": done["modified"], "upsertedIds": [] if done["upserted"] is None else [done["upserted"]]}

    def delete(self, db: str, name: str, body: dict) -> Any:
        c = self.database(db).collection(name)
        return {"deleted": (c.delete_one if body.get("single") else c.delete_many)(body.get("filter") or {})}

    def create_index(self, db: str, name: str, body: dict) -> Any:
        keys = body["fieldPaths"] if isinstance(body.get("fieldPaths"), list) else body.get("fieldPath") or []
        return {"created": self.database(db).collection(name).create_index(body["name"], keys, bool(body.get("unique")))}

    def drop_index(self, db: str, name: str, body: dict) -> Any:
        return {"dropped": self.database(db).collection(name).drop_index(body["name"])}

    def list_indexes(self, db: str, name: str, body: dict) -> Any:
        return [{"name": i["name"], "fieldPath": i["field_path"], "fieldPaths": i["field_paths"], "entries": i["entries"]} for i in self.database(db).collection(name).list_indexes()]

    def get_more(self, cursor: str, body: dict) -> Any:
        db, name, key = self.cursors.get(cursor, (None, None, 0))
        if db is None or (db, name) != (body.get("db"), body.get("coll")):
            raise DocumentError(43, "CursorNotFound", f"no cursor {cursor}")
        key, batch = self.database(db).get_more(name, key)
        if not key:
            del self.cursors[cursor]
        return {"batch": batch, "cursorId": cursor if key else "0"}

    def kill(self, body: dict) -> Any:
        killed, unknown = [], []
        for cursor in map(str, body.get("cursorIds") or []):
            known = self.cursors.pop(cursor, None)
            if known:
                self.database(known[0]).kill_cursors([known[2]])
            (killed if known else unknown).append(cursor)
        return {"killed": killed, "notFound": unknown}

    def route(self, url: str, body: dict) -> Any:
        parts = url.strip("/").split("/")
        if parts[:2] != ["api", "v1"]:
            raise Refused(404, "Not Found")
        if parts[2:] == ["cursors", "kill"]:
            return self.kill(body)
        if len(parts) == 5 and parts[2] == "cursors" and parts[4] == "get-more":
            return self.get_more(parts[3], body)
        if len(parts) < 5:
            raise Refused(404, "Not Found")
        action = self.actions.get("/".join(parts[4:]))
        if action is None:
            raise Refused(404, "Unknown action")
        return action(parts[2], parts[3], body)


def _json(x: Any) -> Any:
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    if hasattr(x, "toPython"):
        return x.toPython()
    return x.hex() if isinstance(x, (bytes, bytearray)) else str(x)


def start_server(spark: SparkSession, root: str, port: int, host: str = "127.0.0.1", token: str = "", max_body: int = MAX_BODY) -> ThreadingHTTPServer:
    """A server in its own thread. Without a token it listens on loopback addresses only."""
    if not token and host not in LOOPBACK:
        raise ValueError(f"a server without a token does not listen on {host}")
    service = Service(spark, root)

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: Any) -> None:
            data = json.dumps(body, default=_json).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def refuse(self) -> None:
            self.answer(405, {"error": "Method Not Allowed"})

        do_GET = do_PUT = do_DELETE = do_PATCH = refuse  # noqa: N815

        def do_POST(self) -> None:  # noqa: N802
            try:
                given = self.headers.get("Authorization", "")
                if token and not (given.startswith("Bearer ") and hmac.compare_digest(given[7:].encode(), token.encode())):
                    raise Refused(401, "Unauthorized")
                size = int(self.headers.get("Content-Length") or 0)
                if size > max_body:
                    raise Refused(413, "Payload Too Large")
                try:
                    body = json.loads(self.rfile.read(size) or b"{}")
                except ValueError:
                    raise Refused(400, "Invalid JSON") from None
                with service.lock:
                    self.answer(200, service.route(self.path, body))
            except Refused as e:
                self.answer(e.status, {"error": e.message})
            except DocumentError as e:
                self.answer(400, {"error": e.name, "code": e.code})
            except CompileError as e:
                self.answer(400, {"error": str(e)})
            except Exception:
                logging.getLogger("foliant.server").exception("a request failed")
                self.answer(500, {"error": "Internal Server Error"})

        def log_message(self, *args: Any) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
