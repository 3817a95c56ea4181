"""Search, profiles and the decomposition of a series."""

import datetime as dt
import random

import numpy as np
import pytest

from tallyframe.config import PROFILES
from tallyframe.operators import analytics, learn

SPACE = {"a": tuple(range(10)), "b": tuple(range(10)), "c": tuple(range(10))}


def cost(p):
    return sum((p.get(k, 0) - want) ** 2 for k, want in (("a", 7), ("b", 3), ("c", 5)))


def test_search_learns_from_its_trials():
    found, chance = [], []
    for seed in range(12):
        best, score, log = learn.search(SPACE, cost, 80, seed)
        assert log[0]["params"] == {} and len(log) == 80 and score == min(r["score"] for r in log) == cost(best)
        assert len({tuple(r["params"].items()) for r in log}) == 80
        found.append(score)
        rnd = random.Random(seed)
        chance.append(min(cost({k: rnd.choice(v) for k, v in SPACE.items()}) for _ in range(79)))
    assert np.mean(found) < 0.7 * np.mean(chance)


def test_search_ends():
    assert len(learn.search({"a": (1, 2)}, cost, 50)[2]) == 3  # the defaults and the whole space
    assert len(learn.search(SPACE, cost, 10**6, seconds=0.05)[2]) < 10**5
    assert learn.search({}, lambda p: 1.0, 5)[0] == {}


def test_profiles():
    assert {k: (p.bench_trees, p.trials, p.folds, p.final_trees, p.permutation_repeats) for k, p in PROFILES.items()} == {
        "fast": (500, 100, 1, 1000, 5), "moderate": (1500, 200, 3, 5000, 5), "efficient": (800, 300, 1, 1500, 5), "optimized": (1500, 500, 3, 5000, 5)}
    assert learn.objective_of(12) == "tweedie" and learn.objective_of(11) == "rmse"


@pytest.mark.parametrize("name", ["fast", "efficient"])
def test_training_run(spark, name):
    """Every phase that a profile asks for, with few trees and trials."""
    import dataclasses

    rnd = np.random.default_rng(1)
    rows = [("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), *map(float, rnd.normal(size=3))) for i in range(160)]
    df = spark.createDataFrame(rows, "series_id string, date date, n1 double, n2 double, n3 double").selectExpr("*", "20 + 5 * n1 AS sales").cache()
    train, valid = df.where("date < date '2024-05-01'"), df.where("date >= date '2024-05-01'")
    profile = dataclasses.replace(PROFILES[name], trials=2)
    out = learn.training_run(train, valid, [(train, valid)], ["n1", "n2", "n3"], [], profile, families=("forest", "ridge"), trees=3)
    assert out["family"] == "forest" and [r["family"] for r in out["bench"]] == ["forest", "ridge"]
    assert bool(out["importance"]) == bool(out["elimination"]) == profile.selection
    assert "n1" in out["features"] and out["score"] > 0
    if profile.selection:
        assert list(out["importance"])[0] == "n1"
    df.unpersist()


def test_partial_autocorrelation(spark):
    rnd = np.random.default_rng(3)
    x = [0.0, 0.0]
    for e in rnd.normal(size=600):
        x.append(0.6 * x[-1] - 0.3 * x[-2] + e)
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(50 + v)) for i, v in enumerate(x)], "date date, sales double")
    got = {r.lag: r.pacf for r in analytics.partial_autocorrelation(df, 6).collect()}
    y = np.array(x) - np.mean(x)
    rho = np.array([(y[k:] * y[: len(y) - k]).sum() for k in range(7)]) / (y * y).sum()
    for k in range(1, 7):  # the last coefficient of an autoregression of that order, by its normal equations
        system = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(np.linalg.solve(system, rho[1 : k + 1])[-1], abs=1e-9)


def test_stl(spark):
    t = np.arange(140)
    season = np.tile([5, 1, -2, -3, -2, 0, 1], 20).astype(float)
    trend = 30 + 0.2 * t
    noise = np.random.default_rng(4).normal(scale=0.2, size=140)
    seasonal, own, rest = analytics.seasonal_trend(trend + season + noise, 7)
    assert np.abs(seasonal - season)[7:-7].max() < 0.6 and np.abs(own - trend)[7:-7].max() < 0.6
    assert np.allclose(seasonal + own + rest, trend + season + noise)
    spiked = trend + season + noise
    spiked[70] += 60
    soft = analytics.seasonal_trend(spiked, 7, robust=5)[1]
    assert abs(soft[70] - trend[70]) < 2 < abs(analytics.seasonal_trend(spiked, 7)[1][70] - trend[70])
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=int(k)), float(v) * m) for s, m in (("a", 1), ("b", 2)) for k, v in zip(t, trend + season)]
    out = analytics.stl(spark.createDataFrame(rows, "series_id string, date date, sales double")).toPandas()
    assert len(out) == 280 and np.allclose(out.seasonal + out.trend + out.rest, out.sales)
    assert analytics.stl(spark.createDataFrame(rows[:3], "series_id string, date date, sales double")).count() == 3
