"""Forecasters, selection, registry, serving and plans."""

import datetime as dt

import numpy as np
import pytest

from tallyframe.config import BY_NAME
from tallyframe.operators import forecast, learn, registry, serve
from tallyframe.sources import files

DAY = dt.date(2024, 1, 1)
SMALL = "/root/testdata/sf0.001"


def series(spark, values, start=0, name="S"):
    return spark.createDataFrame([(name, DAY + dt.timedelta(days=start + i), float(v)) for i, v in enumerate(values)], "series_id string, date date, sales double")


def test_naive(spark):
    train = series(spark, range(1, 15))
    valid = series(spark, [0] * 9, 14).unionByName(series(spark, [0], 14, "new"))
    get = lambda df: [r.forecast for r in df.where("series_id = 'S'").orderBy("date").collect()]
    assert get(forecast.seasonal_naive(train, valid, 7)) == [8, 9, 10, 11, 12, 13, 14, 8, 9]
    assert get(forecast.drift(train, valid))[:2] == [15, 16]
    assert get(forecast.historical_mean(train, valid))[0] == 7.5
    assert get(forecast.moving_average(train, valid, 2))[0] == 13.5
    for f in (lambda: forecast.seasonal_naive(train, valid, 7), lambda: forecast.drift(train, valid), lambda: forecast.historical_mean(train, valid)):
        assert f().where("series_id = 'new'").first().forecast == 0


@pytest.mark.parametrize("fit", [forecast.holt_winters(7), forecast.theta(7), forecast.seasonal_arima(7), forecast.harmonic_regression((7.0,), 3)])
def test_classical_follow_the_season(fit):
    t = np.arange(120)
    y = 50 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 7)
    ahead = np.arange(120, 141)
    want = 50 + 0.1 * ahead + 10 * np.sin(2 * np.pi * ahead / 7)
    assert np.abs(fit(y, 21) - want).mean() < 3


def test_classical_falls_back(spark):
    train, valid = series(spark, [3, 4, 5]), series(spark, [0, 0], 3)
    out = forecast.forecast_by_series(train, valid, forecast.theta(7)).collect()
    assert [r.forecast for r in out] == [5, 5]
    assert not forecast.sane(np.array([1e9]), np.array([1.0, 2.0])) and not forecast.sane(np.array([np.nan]), np.array([1.0]))


def test_elimination():
    useful = {"a", "b"}
    evaluate = lambda names: 1.0 + 10 * len(useful - set(names)) + 0.001 * len(names)
    names, score, log = learn.eliminate(list("abcdefgh"), {x: float(x in useful) for x in "abcdefgh"}, evaluate, 0.001, 4)
    assert set(names) == useful and score == pytest.approx(1.002)
    assert any(r["n_removed"] > 1 and r["accepted"] for r in log)


def test_search_is_seeded():
    space = {"x": (1, 2, 3, 4), "y": (1, 2)}
    runs = [learn.search(space, lambda p: abs(p.get("x", 9) - 3), 6) for _ in range(2)]
    assert runs[0] == runs[1] and runs[0][2][0]["params"] == {} and len(runs[0][2]) == 6


@pytest.mark.parametrize("family", ["gbt", "ridge"])
def test_families_repeat(spark, family):
    rnd = np.random.default_rng(42)
    rows = [(f"S{i % 3}", DAY + dt.timedelta(days=i), *map(float, rnd.normal(size=2)), "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "series_id string, date date, n1 double, n2 double, c string").selectExpr("*", "10 + 3 * n1 + if(c = 'a', 2D, 0D) AS sales")
    runs = [[r.forecast for r in learn.predict(learn.fit(df, ["n1", "n2", "c"], ["c"], family), df, ["n1", "n2", "c"], ["c"]).orderBy("date").collect()] for _ in range(2)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("versions, tolerance, want", [
    ({"1": (0.5, 0.1), "2": (0.45, 0.1)}, 0.05, 0), ({"1": (0.5, 0.1), "2": (0.6, 0.2)}, 0.05, 2), ({"1": (0.5, 0.1), "2": (0.52, 0.1)}, 0.1, 0),
    ({"1": (0.5, 0.1)}, 0.05, 0), ({"1": (0.5, None), "2": (0.6, 0.3)}, 0.05, 1),
])
def test_gate(spark, versions, tolerance, want):
    entry = {"versions": {k: {"wrmsse_test": a, "wape_test": b} for k, (a, b) in versions.items()}}
    assert len(registry.regressions(entry, tolerance)) == want
    table = registry.regression_table(registry.registry_frame(spark, {"k": entry}), tolerance)
    assert table.first().violations == want


def test_registry(spark, tmp_path):
    r = registry.Registry(str(tmp_path))
    own = registry.Artifact(1, "daily", "sales", "ridge", ["n1"], {}, "2024-01-01", {"wape_test": 0.1})
    with pytest.raises(FileNotFoundError):
        r.resolve(1)
    r.add(own, version="20240101T000000Z")
    r.add(own, version="20240102T000000Z")
    assert r.resolve(1)[1] == "20240102T000000Z" and r.resolve(1, version="20240101T000000Z")[1] == "20240101T000000Z"
    with pytest.raises(KeyError):
        r.resolve(1, version="nope")
    own.grain = "weekly"
    r.add(own, version="20240103T000000Z")
    with pytest.raises(ValueError):
        r.resolve(1)
    assert r.resolve(1, grain="weekly")[0].startswith("level_01_weekly") and r.first_grain(1) == "daily"
    with pytest.raises(ValueError):
        r.resolve(1, grain="monthly")
    assert len(r.levels()) == 2 and r.backfill() == []
    (tmp_path / "registry.json").unlink()
    assert len(r.backfill(dry_run=True)) == 3 and r.entries() == {}
    assert len(r.backfill()) == 3 and r.resolve(1, grain="daily")[1] == "20240102T000000Z"


def test_feature_row():
    names, categories = ["store_id", "avg_sell_price", "is_weekend"], {"store_id": ["CA_1", "CA_2"]}
    good = {"is_weekend": 1, "avg_sell_price": "2.5", "store_id": "CA_1"}
    assert list(serve.feature_row(good, names, categories).items()) == [("store_id", "CA_1"), ("avg_sell_price", 2.5), ("is_weekend", 1.0)]
    assert serve.feature_row(good | {"store_id": None}, names, categories)["store_id"] is None
    for bad in ({k: v for k, v in good.items() if k != "is_weekend"}, good | {"x": 1}, good | {"avg_sell_price": "much"}):
        with pytest.raises(serve.BadRow):
            serve.feature_row(bad, names, categories)


def test_target_row(spark):
    from tallyframe.operators import features
    from tallyframe.plans import panel

    history = panel.dense_panel(spark, SMALL, "cat", "weekly")
    last = history.orderBy("date", ascending=False).first()
    row = serve.target_rows(history, "weekly", last.series_id, last.date + dt.timedelta(days=7), {"snap": 1}, features.featured).collect()
    assert len(row) == 1 and row[0].lag1 is not None and row[0].snap == 1
    with pytest.raises(ValueError):
        serve.target_rows(history, "weekly", last.series_id, last.date, {"sales": 3}, features.featured)
    with pytest.raises(KeyError):
        serve.target_rows(history, "weekly", "nobody", last.date, None, features.featured)


def test_levels_add_up(spark):
    from tallyframe.plans import panel

    sums = {name: panel.dense_base(spark, SMALL, name, "daily").agg({"sales": "sum"}).first()[0] for name in ("total", "state", "cat")}
    assert sums["state"] == pytest.approx(sums["total"]) and sums["cat"] == pytest.approx(sums["total"])


def test_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\na,i,d,c,s,t,3,\n")
    rows = files.unpivot_days(files.read_wide(spark, str(tmp_path / "w.csv"))).collect()
    assert [(r.id, r.d, r.sales) for r in rows] == [("a", "d_1", 3)]
    assert files.parse_name("x/level_05_weekly_state_cat.parquet") == (BY_NAME["state_cat"], "weekly")
    with pytest.raises(ValueError):
        files.parse_name("other.parquet")


def test_filters_reach_the_scan(spark):
    from tallyframe.sources import star

    plan = star.read(spark, SMALL, "lineitem").where("l_quantity > 10").select("l_partkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan


def test_one_exchange_for_panel_windows(spark):
    from tallyframe.operators import features
    from tallyframe.plans import panel

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        base = spark.createDataFrame([], panel.dense_panel(spark, SMALL, "cat", "daily").schema)
        plan = features.intermittency_features(features.event_features(features.price_features(base)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
