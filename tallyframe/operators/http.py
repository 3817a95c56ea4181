"""The serving endpoints over HTTP: /health, /levels, /predict/<level> and /predict/<level>/forecast.

What is answered is decided by ``Service.answer`` from a method, a path and a body, so it needs no socket; ``server`` puts it on one.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession

from tallyframe.config import BY_ID, GRAINS
from tallyframe.operators import learn, serve
from tallyframe.operators.registry import Artifact, Registry

Panel = Callable[[int, str], DataFrame]
Features = Callable[[DataFrame, str], DataFrame]


class Refused(Exception):
    """A request that is answered by an error."""

    def __init__(self, status: HTTPStatus, detail: object):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Service:
    """panel gives the history of a level by grain with exogenous columns, features what training made of it."""

    def __init__(self, spark: SparkSession, registry: Registry, panel: Panel, features: Features):
        self.spark, self.registry, self.panel, self.features = spark, registry, panel, features

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
        """The status and the JSON value of a request."""
        url = urlsplit(target)
        options = dict(parse_qsl(url.query))
        try:
            if (method, url.path) == ("GET", "/health"):
                return HTTPStatus.OK, serve.health()
            if (method, url.path) == ("GET", "/levels"):
                return HTTPStatus.OK, self.levels(options.get("target", "sales"), options.get("grain"))
            found = re.fullmatch(r"/predict/(\d+)(/forecast)?", url.path)
            if method == "POST" and found:
                run = self.forecast if found[2] else self.predict
                return HTTPStatus.OK, run(int(found[1]), options.get("target", "sales"), options.get("grain"), self._json(body))
            raise Refused(HTTPStatus.NOT_FOUND, f"no {method} {url.path}")
        except Refused as error:
            return error.status, {"detail": error.detail}

    @staticmethod
    def _json(body: bytes) -> dict:
        try:
            value = json.loads(body or b"{}")
        except ValueError as error:
            raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"not JSON: {error}") from None
        if not isinstance(value, dict):
            raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, "not an object")
        return value

    def levels(self, target: str, grain: str | None) -> list[dict]:
        """A row for each level and grain that has a model of the target."""
        if grain is not None and grain not in GRAINS:
            raise Refused(HTTPStatus.BAD_REQUEST, f"unknown grain {grain!r}")
        out = []
        for level in BY_ID.values():
            for g in [grain] if grain else GRAINS:
                try:
                    _, version, name = self.registry.resolve(level.id, target, grain=g)
                except FileNotFoundError:
                    continue
                measures = self.registry.artifact(name).metrics
                out.append({"level_id": level.id, "level": level.name, "grain": g, "target": target, "version": version, "wape_test": measures.get("wape_test"), "wrmsse_test": measures.get("wrmsse_test")})
        return out

    def _model(self, level: int, target: str, grain: str | None, version: str | None) -> tuple[str, str, Artifact]:
        try:
            _, version, name = self.registry.resolve(level, target, version, grain)
        except (FileNotFoundError, KeyError) as error:
            raise Refused(HTTPStatus.NOT_FOUND, str(error)) from None
        except ValueError as error:
            raise Refused(HTTPStatus.BAD_REQUEST, str(error)) from None
        return version, name, self.registry.artifact(name)

    def _forecast(self, name: str, artifact: Artifact, values: dict) -> float:
        """The model's forecast for one row of features."""
        try:
            row = serve.feature_row(values, artifact.features, artifact.categories)
        except serve.BadRow as error:
            raise Refused(HTTPStatus.BAD_REQUEST, error.args[0]) from None
        schema = ", ".join(f"`{c}` {'string' if c in artifact.categories else 'double'}" for c in artifact.features)
        frame = self.spark.createDataFrame([tuple(row.values())], schema)
        return learn.predict(self.registry.model(name), frame, artifact.features, list(artifact.categories)).first().forecast

    def predict(self, level: int, target: str, grain: str | None, body: dict) -> dict:
        """features: a value for each of the model's features."""
        version, name, artifact = self._model(level, target, grain, body.get("version"))
        return {"level_id": level, "grain": artifact.grain, "target": target, "version": version, "prediction": self._forecast(name, artifact, body.get("features") or {})}

    def forecast(self, level: int, target: str, grain: str | None, body: dict) -> dict:
        """series_id and date, and overrides of what is known of that day; the features are built as in training."""
        version, name, artifact = self._model(level, target, grain, body.get("version"))
        try:
            series, date = body["series_id"], dt.date.fromisoformat(body["date"])
        except (KeyError, TypeError, ValueError) as error:
            raise Refused(HTTPStatus.UNPROCESSABLE_ENTITY, f"series_id and date: {error}") from None
        try:
            rows = serve.target_rows(self.panel(level, artifact.grain), artifact.grain, series, date, body.get("overrides"), self.features)
        except KeyError as error:
            raise Refused(HTTPStatus.NOT_FOUND, str(error)) from None
        except ValueError as error:
            raise Refused(HTTPStatus.BAD_REQUEST, str(error)) from None
        row = rows.select(*artifact.features).first().asDict()
        return {"level_id": level, "series_id": series, "date": date.isoformat(), "grain": artifact.grain, "target": target, "version": version, "prediction": self._forecast(name, artifact, row)}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that answers by the service; serve_forever() starts it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            status, value = service.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            text = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = _reply

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
