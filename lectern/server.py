"""A small HTTP front: photos in, results out. Reading itself is a function that the caller gives."""

from __future__ import annotations

import hmac
import json
import os
import threading
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from lectern.catalog import Catalog, CatalogError
from lectern.plans.reading import ENGINE
from lectern.sources.runtime import DEVICES

MAX_BYTES = 20 << 20


class ConfigError(ValueError):
    """A setting that the server cannot run with."""


@dataclass(frozen=True)
class ServerConfig:
    """What the server reads with, and how many photos at once."""

    model: str
    token: str | None = None
    device: str = "cpu"
    threads: int = 1
    concurrency: int = 2
    max_bytes: int = MAX_BYTES

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ServerConfig:
        """Settings LECTERN_MODEL, _TOKEN, _DEVICE, _THREADS, _CONCURRENCY and _MAX_BYTES; ConfigError names a bad one."""
        env = os.environ if env is None else env

        def count(name: str, default: int) -> int:
            raw = env.get(f"LECTERN_{name}", "")
            if raw and not (raw.isascii() and raw.isdigit() and int(raw) > 0):
                raise ConfigError(f"LECTERN_{name} is a positive number, not {raw!r}")
            return int(raw) if raw else default

        if not env.get("LECTERN_MODEL"):
            raise ConfigError("LECTERN_MODEL is not set")
        if (device := env.get("LECTERN_DEVICE") or "cpu") not in DEVICES:
            raise ConfigError(f"LECTERN_DEVICE is one of {', '.join(DEVICES)}")
        return cls(env["LECTERN_MODEL"], env.get("LECTERN_TOKEN") or None, device, count("THREADS", 1), count("CONCURRENCY", 2), count("MAX_BYTES", MAX_BYTES))


class Refused(Exception):
    """An answer other than a result."""

    def __init__(self, status: int, code: str, message: str, **more: Any) -> None:
        super().__init__(message)
        self.status, self.body = status, {"error": {"code": code, "message": message, **more}}


def make_server(config: ServerConfig, read: Callable[[bytes, Catalog], dict[str, Any]] | None, models: list[dict[str, Any]] | None = None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server for GET /ping, /v1/health, /v1/models and POST /v1/read (JSON: catalog, and image in base64).

    read gives the result of one photo and may raise ValueError for a photo it cannot
    read; without it every reading is answered 503. With a token all but /ping need it.
    """
    slots = threading.Semaphore(config.concurrency)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_: Any) -> None:
            """Nothing: names and texts of photos stay out of logs."""

        def _answer(self, status: int, body: dict[str, Any]) -> None:
            raw = json.dumps(body, ensure_ascii=False, allow_nan=False).encode()
            self.send_response(status)
            for name, value in (("content-type", "application/json"), ("content-length", str(len(raw)))):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def _known(self) -> None:
            kind, _, given = self.headers.get("authorization", "").partition(" ")
            if config.token and not (kind.lower() == "bearer" and hmac.compare_digest(given.encode(), config.token.encode())):
                raise Refused(401, "unauthorized", "the bearer token is missing or wrong")

        def _body(self) -> dict[str, Any]:
            raw = self.headers.get("content-length", "")
            if not raw.isdigit():
                raise Refused(400, "bad_request", "a length is needed")
            if int(raw) > config.max_bytes:
                self.close_connection = True
                raise Refused(413, "too_large", f"at most {config.max_bytes} bytes")
            try:
                body = json.loads(self.rfile.read(int(raw)))
            except ValueError:
                raise Refused(400, "bad_request", "the body is not JSON") from None
            if not isinstance(body, dict) or not isinstance(body.get("image"), str) or not isinstance(body.get("catalog"), dict):
                raise Refused(400, "bad_request", "catalog and image are needed")
            return body

        def _read(self) -> dict[str, Any]:
            import base64

            body = self._body()
            try:
                catalog, content = Catalog.from_dict(body["catalog"]), base64.b64decode(body["image"], validate=True)
            except CatalogError as e:
                raise Refused(400, "bad_catalog", str(e)) from None
            except ValueError:
                raise Refused(400, "bad_image", "the image is not base64") from None
            if read is None:
                raise Refused(503, "model_unavailable", f"{config.model} is not here")
            with slots:
                try:
                    return read(content, catalog)
                except ValueError as e:
                    raise Refused(400, "bad_image", str(e)) from None

        def _route(self, routes: dict[str, Callable[[], dict[str, Any]]]) -> None:
            try:
                path = self.path.split("?")[0]
                if path not in routes:
                    raise Refused(404, "not_found", "there is nothing here")
                if path != "/ping":
                    self._known()
                self._answer(200, routes[path]())
            except Refused as e:
                self._answer(e.status, e.body)

        def do_GET(self) -> None:  # noqa: N802 - named by the base class
            """Questions about the server."""
            health = lambda: {"status": "ok", "engine_version": ENGINE, "model": config.model, "ready": read is not None}
            self._route({"/ping": lambda: {"status": "ok"}, "/v1/health": health, "/v1/models": lambda: {"models": models or []}})

        def do_POST(self) -> None:  # noqa: N802 - named by the base class
            """A photo to read."""
            self._route({"/v1/read": self._read})

    return ThreadingHTTPServer((host, port), Handler)
