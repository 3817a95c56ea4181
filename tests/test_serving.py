"""The endpoints, with and without a socket, and the registry that they read."""

import datetime as dt
import json
import threading
import urllib.request

import pytest

from tallyframe.operators import features, http, learn, registry
from tallyframe.plans import panel
from tallyframe.sources import files
from tallyframe.sources.store import Folder

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    history = panel.dense_panel(spark, SMALL, "cat", "weekly").cache()
    names, categories = ["month", "snap", "cat_id"], {"cat_id": sorted(r.cat_id for r in history.select("cat_id").distinct().collect())}
    model = learn.fit(history, names, ["cat_id"], "forest", {"numTrees": 3, "maxDepth": 3})
    found = registry.Registry(f"file://{tmp_path_factory.mktemp('models')}")
    for grain, version in (("weekly", "20240101T000000Z"), ("weekly", "20240102T000000Z")):
        found.add(registry.Artifact(3, grain, "sales", "forest", names, categories, "1998-01-01", {"wape_test": 0.25}), model, version)
    found.add(registry.Artifact(1, "weekly", "sales", "forest", names, categories, "1998-01-01"), None, "20240101T000000Z")
    found.add(registry.Artifact(1, "daily", "sales", "forest", names, categories, "1998-01-01"), None, "20240101T000000Z")
    yield http.Service(spark, found, lambda level, grain: history, features.featured)
    history.unpersist()


def post(service, path, **body):
    return service.answer("POST", path, json.dumps(body).encode())


def test_health_and_levels(service):
    assert service.answer("GET", "/health") == (200, {"status": "ok"})
    status, rows = service.answer("GET", "/levels")
    assert status == 200 and [(r["level_id"], r["grain"]) for r in rows] == [(1, "daily"), (1, "weekly"), (3, "weekly")]
    assert rows[-1]["version"] == "20240102T000000Z" and rows[-1]["wape_test"] == 0.25 and rows[-1]["wrmsse_test"] is None
    assert len(service.answer("GET", "/levels?grain=daily")[1]) == 1 and service.answer("GET", "/levels?target=other")[1] == []
    assert service.answer("GET", "/levels?grain=monthly")[0] == 400
    assert service.answer("GET", "/nowhere")[0] == 404


def test_predict(service):
    row = {"month": 3, "snap": "0", "cat_id": None}
    status, out = post(service, "/predict/3", features=row)
    assert status == 200 and out["prediction"] >= 0 and (out["grain"], out["version"]) == ("weekly", "20240102T000000Z")
    assert post(service, "/predict/3", features=row, version="20240101T000000Z")[1]["version"] == "20240101T000000Z"
    assert post(service, "/predict/3", features=row, version="x")[0] == 404
    assert post(service, "/predict/5", features=row)[0] == 404 and post(service, "/predict/99", features=row)[0] == 404
    assert post(service, "/predict/1", features=row)[0] == 400  # two grains and no choice
    assert post(service, "/predict/3?grain=monthly", features=row)[0] == 400
    status, out = post(service, "/predict/3", features={"month": 3, "x": 1})
    assert status == 400 and out["detail"] == {"missing": ["cat_id", "snap"], "extra": ["x"]}
    assert post(service, "/predict/3", features=row | {"month": "much"})[0] == 400
    assert service.answer("POST", "/predict/3", b"{")[0] == 422


def test_forecast(service):
    last = service.panel(3, "weekly").orderBy("date", ascending=False).first()
    day = (last.date + dt.timedelta(days=7)).isoformat()
    status, out = post(service, "/predict/3/forecast", series_id=last.series_id, date=day, overrides={"snap": 1})
    assert status == 200 and out["series_id"] == last.series_id and out["date"] == day and out["prediction"] >= 0
    assert post(service, "/predict/3/forecast", series_id="nobody", date=day)[0] == 404
    assert post(service, "/predict/3/forecast", series_id=last.series_id, date=day, overrides={"sales": 1})[0] == 400
    assert post(service, "/predict/3/forecast", series_id=last.series_id)[0] == 422


def test_over_a_socket(service):
    own = http.server(service, port=0)
    thread = threading.Thread(target=own.serve_forever, daemon=True)
    thread.start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{own.server_port}/health") as reply:
            assert json.loads(reply.read()) == {"status": "ok"}
    finally:
        own.shutdown()
        own.server_close()
        thread.join()


def test_folder(spark, tmp_path):
    folder = Folder(f"file://{tmp_path}/new")
    assert folder.read("a.txt") is None and folder.names("*") == []
    folder.write("x/a.txt", "one é")
    folder.write("x/a.txt", "two é")
    assert folder.read("x/a.txt") == "two é" and folder.exists("x/a.txt")
    assert [n for n, _ in folder.names("*/a.txt")] == ["x/a.txt"]
    files.write_json({"b": 1, "a": 2}, f"file://{tmp_path}/m.json")
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 2, "b": 1}
    log = files.log_to(f"file://{tmp_path}/run.log", "tallyframe.test")
    log.info("first"), log.info("second")
    assert [x.split()[-1] for x in (tmp_path / "run.log").read_text().splitlines()] == ["first", "second"]
