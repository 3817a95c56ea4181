"""Classical models against the seasonal naive forecast, and models against it on the panel."""

import datetime as dt

import numpy as np
import pytest

from tallyframe.operators import forecast

MODELS = {"ets": forecast.holt_winters(7), "theta": forecast.theta(7), "sarima": forecast.seasonal_arima(7), "harmonic": forecast.harmonic_regression()}


def series(seed, n=420):
    rnd = np.random.default_rng(seed)
    t = np.arange(n)
    return 60 + 0.05 * t + np.tile([8, 2, -3, -5, -4, 0, 2], n // 7 + 1)[:n] + 4 * np.sin(2 * np.pi * t / 365.25) + rnd.normal(scale=4, size=n)


@pytest.mark.parametrize("name", sorted(MODELS))
def test_better_than_the_last_week(name):
    own, naive = [], []
    for seed in range(12):
        y = series(seed)
        known, ahead = y[:-28], y[-28:]
        own.append(np.abs(MODELS[name](known, 28) - ahead).mean())
        naive.append(np.abs(np.tile(known[-7:], 4) - ahead).mean())
    assert np.mean(own) < 0.95 * np.mean(naive), (np.mean(own), np.mean(naive))


@pytest.mark.parametrize("name", sorted(MODELS))
def test_by_series_in_spark(spark, name):
    day = dt.date(2023, 1, 1)
    rows = [(s, day + dt.timedelta(days=k), float(v)) for s, seed in (("a", 1), ("b", 2)) for k, v in enumerate(series(seed))]
    df = spark.createDataFrame(rows, "series_id string, date date, sales double")
    cut = day + dt.timedelta(days=392)
    from pyspark.sql import functions as F

    out = forecast.forecast_by_series(df.where(F.col("date") < F.lit(cut)), df.where(F.col("date") >= F.lit(cut)), MODELS[name]).toPandas().sort_values(["series_id", "date"])
    for s, seed in (("a", 1), ("b", 2)):
        assert np.allclose(out[out.series_id == s].forecast, MODELS[name](series(seed)[:392], 28))
