"""Errors against worked examples."""

import datetime as dt

import pytest

from tallyframe.operators import metrics

DAY = dt.date(2024, 1, 1)


def evaluated(spark, y, f, series="S"):
    rows = [(series, DAY + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, f))]
    return spark.createDataFrame(rows, "series_id string, date date, sales double, forecast double")


def test_point(spark):
    df = evaluated(spark, [0, 2, 0, 3, 1, 0, 4, 0, 2, 3], [1, 1, 1, 2, 2, 1, 3, 1, 2, 2])
    got = df.agg(*(c.alias(n) for n, c in metrics.point().items())).first()
    want = {"wape": 0.60, "bias": 1 / 15, "mae": 0.9, "rmse": 0.949, "smape": 1.042, "rmsle": 0.497, "tracking_signal": -1.11}
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=2e-3), name


def test_scaled(spark):
    train = spark.createDataFrame([("S", DAY + dt.timedelta(days=i), float(y)) for i, y in enumerate([1, 0, 2, 0, 3, 1, 0, 2, 1])], "series_id string, date date, sales double")
    scales = metrics.naive_scales(train)
    assert scales.first().mse_scale == pytest.approx(3.0, abs=0.6) and scales.first().mae_scale > 0
    own = metrics.scaled_by_series(evaluated(spark, [2, 0, 3, 1, 4], [1, 1, 2, 2, 3]), scales).first()
    assert own.rmsse == pytest.approx((1.0 / scales.first().mse_scale) ** 0.5)
    assert own.mase == pytest.approx(1.0 / scales.first().mae_scale)


def test_leading_zeros_and_flat_series(spark):
    rows = [("A", [0, 0, 4, 6]), ("B", [0, 0, 0, 0]), ("C", [3, 3, 3, 3])]
    train = spark.createDataFrame([(s, DAY + dt.timedelta(days=i), float(y)) for s, ys in rows for i, y in enumerate(ys)], "series_id string, date date, sales double")
    got = {r.series_id: r.mse_scale for r in metrics.naive_scales(train).collect()}
    assert got == {"A": 4.0, "C": 0.0}
    valid = evaluated(spark, [1], [2], "C").unionByName(evaluated(spark, [1], [2], "A"))
    own = {r.series_id: r.rmsse for r in metrics.scaled_by_series(valid, metrics.naive_scales(train)).collect()}
    assert own["C"] is None and own["A"] == 0.5


def test_weights(spark):
    per = spark.createDataFrame([("A", 0.535), ("B", 0.505), ("C", None)], "series_id string, rmsse double")
    weights = spark.createDataFrame([("A", 100.0), ("B", 160.0), ("C", 5.0)], "series_id string, weight double")
    assert metrics.weighted(per, weights, {"w": "rmsse"}).first().w == pytest.approx(0.5165, abs=1e-3)
    assert metrics.weighted(per, None, {"w": "rmsse"}).first().w == pytest.approx(0.52)
    assert metrics.weighted(per, weights.selectExpr("series_id", "weight * 0 AS weight"), {"w": "rmsse"}).first().w == pytest.approx(0.52)


@pytest.mark.parametrize("y, f, want", [([0, 3, 0, 0], [3, 0, 0, 0], 0.188), ([0, 3, 0, 0], [0, 0, 3, 0], 0.563), ([0, 3, 0, 0], [0, 3, 0, 0], 0.0)])
def test_spec(spark, y, f, want):
    assert metrics.spec_by_series(evaluated(spark, y, f)).first().spec == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("f, want", [([1, 1, 1, 1, 10], 3.200), ([0, 0, 0, 0, 8], 0.035)])
def test_tweedie(spark, f, want):
    assert evaluated(spark, [0, 0, 0, 0, 10], f).agg(metrics.objective("tweedie").alias("s")).first().s == pytest.approx(want, abs=5e-3)


def test_report_has_nulls_for_zero_sales(spark):
    df = evaluated(spark, [0, 2], [1.5, 2.5]).selectExpr("*", "sales * 2 AS gross_sales", "2.0D AS avg_sell_price")
    rows = metrics.predictions_report(df).orderBy("date").collect()
    assert rows[0].wape is None and rows[0].y_pred == 2.0 and rows[1].y_pred == 2.0 and rows[1].wape == 0
