"""Registered queries of splits, forecasts, errors, model selection and the registry."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import oracle as o
from tallyframe.config import AVERAGE_WINDOWS, DIMS, NAIVE_SEASONS
from tallyframe.operators import analytics, features, forecast, learn, metrics, registry, serve, split
from tallyframe.plans import panel as plans
from tallyframe.queries import GRAIN, LEVEL, K, _dense, _evented, register, rounded
from tallyframe.sources import files, star

SPLIT = o.split_dates(364, 28)


def on_split(select: str, ctes: str = "") -> str:
    return o.on_dense(LEVEL, GRAIN, f"{o.EVENTED}, {SPLIT}{', ' + ctes if ctes else ''}", select)


def _dates(spark: SparkSession, sf_dir: str, grain: str = GRAIN) -> split.Split:
    """The default split of a panel. Its dates are the calendar's, so the panel isn't built to find them."""
    days = star.calendar(spark, sf_dir)
    return split.default_split(days.where("wday = 1") if grain == "weekly" else days, grain)


def _split(spark: SparkSession, sf_dir: str, level: str = LEVEL, grain: str = GRAIN) -> tuple[DataFrame, split.Split]:
    """The panel with closures zeroed, and its default split."""
    return _evented(spark, sf_dir, level, grain), _dates(spark, sf_dir, grain)


# splits -----------------------------------------------------------------------------------------------------------------------
@register("date_split", on_split(f"SELECT CASE WHEN date < valid_start THEN 'train' WHEN date < test_start THEN 'valid' ELSE 'test' END AS split, MIN(date) AS first, MAX(date) AS last, {o.b('COUNT(*)', 'n')} FROM e, bounds GROUP BY 1"))
def date_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    return df.groupBy(s.label().alias("split")).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


@register("truncate_end", o.on_dense("cat", "weekly", "", f"SELECT series_id, date, {o.r('sales', 2)} FROM p WHERE date <= (SELECT MAX(date) - 28 FROM p)"))
def truncate_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dense(spark, sf_dir, "cat", "weekly")
    return rounded(split.truncate_end(df, df.agg(F.max("date").alias("d")).first().d - dt.timedelta(days=28)).select(*K, "sales"), 2)


@register("block_origins", on_split(f"SELECT series_id, date, valid_start + CAST((date - valid_start) // 28 * 28 AS INTEGER) - 1 AS origin, {o.i('date - (valid_start + CAST((date - valid_start) // 28 * 28 AS INTEGER) - 1)', 'h')} FROM valid, bounds"))
def block_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    return s.valid(df).select(*K, split.block_origin(s.valid_start, GRAIN).alias("origin"), split.horizon(s.valid_start, GRAIN).alias("h"))


@register("valid_blocks", on_split(f"SELECT {o.i('(date - valid_start) // 28', 'block')}, MIN(date) AS first, MAX(date) AS last, {o.b('COUNT(*)', 'n')} FROM valid, bounds GROUP BY 1"))
def valid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    blocks = spark.createDataFrame(split.valid_blocks(s.valid_start, s.test_start, GRAIN), "block int, a date, z date")
    # 13 blocks: broadcast, and a day is in one of them
    return s.valid(df).join(F.broadcast(blocks), (F.col("date") >= F.col("a")) & (F.col("date") < F.col("z"))).groupBy("block").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


_MASKED = ("lag1", "lag7", "lag28", "rolling_mean_lag7_window_size14", "momentum_lag1_7_35")
_MASK_SQL = ", ".join(
    o.r(f"CASE WHEN split = 'train' OR h <= {split.anchor(c)} THEN {c} END", 4, c) for c in _MASKED
)
_LAGGED = f"""lagged AS (SELECT *, LAG(sales, 1) OVER ({o.W}) AS lag1, LAG(sales, 7) OVER ({o.W}) AS lag7, LAG(sales, 28) OVER ({o.W}) AS lag28,
    CASE WHEN COUNT(*) OVER ({o.W} ROWS BETWEEN 20 PRECEDING AND 7 PRECEDING) = 14 THEN AVG(sales) OVER ({o.W} ROWS BETWEEN 20 PRECEDING AND 7 PRECEDING) END AS rolling_mean_lag7_window_size14,
    CASE WHEN COUNT(*) OVER ({o.W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN AVG(sales) OVER ({o.W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END
    / NULLIF(CASE WHEN COUNT(*) OVER ({o.W} ROWS BETWEEN 35 PRECEDING AND 1 PRECEDING) = 35 THEN AVG(sales) OVER ({o.W} ROWS BETWEEN 35 PRECEDING AND 1 PRECEDING) END, 0) AS momentum_lag1_7_35 FROM e),
labelled AS (SELECT l.*, valid_start, CASE WHEN date < valid_start THEN 'train' WHEN date < test_start THEN 'valid' ELSE 'test' END AS split,
    (date - CASE WHEN date < test_start THEN valid_start ELSE test_start END) % 28 + 1 AS h FROM lagged l, bounds)"""


@register("mask_horizon", on_split(f"SELECT series_id, date, split, {_MASK_SQL} FROM labelled", _LAGGED))
def mask_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    lagged = features.lag_features(df, GRAIN, only="^(" + "|".join(_MASKED) + ")$").select(*K, *_MASKED)
    return rounded(split.masked_split(lagged, s, GRAIN))


@register("rolling_cv", on_split(f"SELECT f.fold, f.part, {o.b('COUNT(*)', 'n')}, {o.b('COUNT(lag7)', 'known')} FROM (" + " UNION ALL ".join(
    f"SELECT {3 - b} AS fold, CASE WHEN date < valid_start - {28 * b} THEN 'train' ELSE 'valid' END AS part, CASE WHEN date < valid_start - {28 * b} OR (date - (valid_start - {28 * b})) % 28 + 1 <= 7 THEN lag7 END AS lag7 FROM labelled l WHERE date < " + (f"valid_start - {28 * b} + 28" if b else "(SELECT test_start FROM bounds)")
    for b in (2, 1, 0)) + ") f GROUP BY ALL", _LAGGED))
def rolling_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    lagged = features.lag_features(df, GRAIN, only="^lag7$").select(*K, "lag7")
    parts = [x.select(F.lit(k + 1).alias("fold"), F.lit(name).alias("part"), "lag7") for k, pair in enumerate(split.rolling_folds(lagged, s, GRAIN, 3)) for name, x in zip(("train", "valid"), pair)]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("fold", "part").agg(F.count("*").alias("n"), F.count("lag7").alias("known"))


# forecasts --------------------------------------------------------------------------------------------------------------------
_TAIL = "tail AS (SELECT series_id, sales, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM train), ahead AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS h FROM valid)"


def _naive(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    df, s = _split(spark, sf_dir)
    return rounded(run(s.train(df), s.valid(df)).select(*K, "sales", "forecast"), sales=2)


@register("seasonal_naive", on_split(f"SELECT a.series_id, a.date, {o.r('a.sales', 2)}, {o.r('COALESCE(t.sales, 0)', 4, 'forecast')} FROM ahead a LEFT JOIN tail t ON a.series_id = t.series_id AND t.back = 7 - (a.h - 1) % 7", _TAIL))
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(spark, sf_dir, lambda a, b: forecast.seasonal_naive(a, b, 7))


@register("drift", on_split(f"SELECT a.series_id, a.date, {o.r('a.sales', 2)}, {o.r('COALESCE(z + h * CASE WHEN n > 1 THEN (z - y) / (n - 1) ELSE 0 END, 0)', 4, 'forecast')} FROM ahead a LEFT JOIN ends USING (series_id)", f"{_TAIL}, ends AS (SELECT series_id, MIN_BY(sales, date) AS y, MAX_BY(sales, date) AS z, COUNT(*) AS n FROM train GROUP BY 1)"))
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(spark, sf_dir, forecast.drift)


@register("historical_mean", on_split(f"SELECT a.series_id, a.date, {o.r('a.sales', 2)}, {o.r('COALESCE(m, 0)', 4, 'forecast')} FROM ahead a LEFT JOIN (SELECT series_id, AVG(sales) AS m FROM train GROUP BY 1) USING (series_id)", _TAIL))
def historical_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(spark, sf_dir, forecast.historical_mean)


@register("moving_average", on_split(f"SELECT a.series_id, a.date, {o.r('a.sales', 2)}, {o.r('COALESCE(m, 0)', 4, 'forecast')} FROM ahead a LEFT JOIN (SELECT series_id, AVG(sales) AS m FROM tail WHERE back <= 28 GROUP BY 1) USING (series_id)", _TAIL))
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(spark, sf_dir, lambda a, b: forecast.moving_average(a, b, 28))


@register("last_n", on_split(f"SELECT series_id, {o.i('back')}, {o.r('sales', 2)} FROM tail WHERE back <= 7", _TAIL))
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    return rounded(forecast.last_rows(s.train(df), 7).select("series_id", "back", "sales"), 2)


@register("naive_table", on_split(
    "SELECT model, " + o.r("SUM(ABS(sales - f)) / NULLIF(SUM(ABS(sales)), 0)", 4, "wape") + ", " + o.r("SQRT(AVG((sales - f) * (sales - f)))", 3, "rmse") + " FROM (" + " UNION ALL ".join(
        [f"SELECT 'seasonal_naive_{w}' AS model, a.sales, CASE WHEN is_store_closed = 1 THEN 0 ELSE COALESCE(t.sales, 0) END AS f FROM ahead a LEFT JOIN tail t ON a.series_id = t.series_id AND t.back = {w} - (a.h - 1) % {w}" for w in NAIVE_SEASONS[GRAIN]]
        + [f"SELECT 'moving_average_{w}', a.sales, CASE WHEN is_store_closed = 1 THEN 0 ELSE COALESCE(m, 0) END FROM ahead a LEFT JOIN (SELECT series_id, AVG(sales) AS m FROM tail WHERE back <= {w} GROUP BY 1) USING (series_id)" for w in AVERAGE_WINDOWS[GRAIN]]
        + ["SELECT 'drift', a.sales, CASE WHEN is_store_closed = 1 THEN 0 ELSE COALESCE(z + h * (z - y) / NULLIF(n - 1, 0), 0) END FROM ahead a LEFT JOIN (SELECT series_id, MIN_BY(sales, date) AS y, MAX_BY(sales, date) AS z, COUNT(*) AS n FROM train GROUP BY 1) USING (series_id)"]
        + ["SELECT 'historical_mean', a.sales, CASE WHEN is_store_closed = 1 THEN 0 ELSE COALESCE(m, 0) END FROM ahead a LEFT JOIN (SELECT series_id, AVG(sales) AS m FROM train GROUP BY 1) USING (series_id)"]
    ) + ") GROUP BY model", _TAIL))
def naive_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    return rounded(learn.naive_table(s.train(df), s.valid(df), GRAIN), 4, rmse=3)


def _classical(fit):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, s = _split(spark, sf_dir, "cat")
        return rounded(forecast.forecast_by_series(s.train(df), s.valid(df), fit).select(*K, "sales", "forecast"), 2)

    return run


for _name, _fit in (("ets", forecast.holt_winters(7)), ("theta", forecast.theta(7)), ("sarima", forecast.seasonal_arima(7)), ("harmonic_regression", forecast.harmonic_regression())):
    register(_name)(_classical(_fit))


# errors -----------------------------------------------------------------------------------------------------------------------
#: What is known before the test days, and the test days with a weekly naive forecast.
_EVAL = """known AS (SELECT e.* FROM e, bounds WHERE date < test_start),
kt AS (SELECT series_id, sales, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS back FROM known),
fc AS (SELECT a.*, CASE WHEN is_store_closed = 1 THEN 0 ELSE COALESCE(t.sales, 0) END AS f FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS h FROM test) a LEFT JOIN kt t ON a.series_id = t.series_id AND t.back = 7 - (a.h - 1) % 7)"""
_SCALE = f"""st AS (SELECT *, MAX(CASE WHEN sales <> 0 THEN 1 ELSE 0 END) OVER ({o.W} {o.UP}) AS started FROM known),
sd AS (SELECT series_id, sales - LAG(sales) OVER ({o.W}) AS x FROM st WHERE started = 1), sc AS (SELECT series_id, AVG(x * x) AS mse_scale, AVG(ABS(x)) AS mae_scale FROM sd GROUP BY 1 HAVING AVG(x * x) IS NOT NULL),
wt AS (SELECT series_id, COALESCE(SUM(sales * avg_sell_price), 0) AS weight FROM known WHERE date > (SELECT MAX(date) - 28 FROM known) GROUP BY 1),
ss AS (SELECT fc.series_id, SQRT(AVG((sales - f) * (sales - f)) / NULLIF(MAX(mse_scale), 0)) AS rmsse, AVG(ABS(sales - f)) / NULLIF(MAX(mae_scale), 0) AS mase FROM fc LEFT JOIN sc USING (series_id) GROUP BY 1)"""
_SPEC = f"""cu AS (SELECT *, SUM(sales) OVER ({o.W} {o.UP}) AS cy, SUM(f) OVER ({o.W} {o.UP}) AS cf FROM fc),
sp AS (SELECT x.series_id, SUM(GREATEST(0, 0.75 * LEAST(x.sales, x.cy - z.cf), 0.25 * LEAST(x.f, x.cf - z.cy)) * (z.h - x.h + 1)) / MAX(n) AS spec
    FROM cu x JOIN cu z ON x.series_id = z.series_id AND x.h <= z.h JOIN (SELECT series_id, COUNT(*) AS n FROM cu GROUP BY 1) c ON x.series_id = c.series_id GROUP BY 1)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is known and the forecasts, from a panel that is written once: errors read either several times."""
    df, s = _split(spark, sf_dir)
    path = files.scratch(spark, "evaluated")
    df.select(*K, *DIMS, "sales", "gross_sales", "avg_sell_price", "is_store_closed").write.parquet(path)
    df = spark.read.parquet(path)
    known = df.where(F.col("date") < F.lit(s.test_start))
    return known, metrics.clip_closed(forecast.seasonal_naive(known, s.test(df), 7))


def _wavg(c: str) -> str:
    return f"COALESCE(SUM({c} * COALESCE(weight, 0)) / NULLIF(SUM(CASE WHEN {c} IS NOT NULL THEN COALESCE(weight, 0) END), 0), AVG({c}))"


_LOG = "LN(1 + GREATEST(f, 0)) - LN(1 + GREATEST(sales, 0))"
_POINT = {
    "wape": "SUM(ABS(sales - f)) / NULLIF(SUM(ABS(sales)), 0)", "bias": "SUM(f - sales) / NULLIF(SUM(ABS(sales)), 0)", "smape": "AVG(2 * ABS(sales - f) / (ABS(sales) + ABS(f) + 1e-8))",
    "mae": "AVG(ABS(sales - f))", "rmse": "SQRT(AVG((sales - f) * (sales - f)))", "rmsle": f"SQRT(AVG(({_LOG}) * ({_LOG})))", "tracking_signal": "COALESCE(SUM(sales - f) / NULLIF(AVG(ABS(sales - f)), 0), 0)",
}


@register("point_metrics", on_split("SELECT cat_id, " + ", ".join(o.r(e, 4, n) for n, e in _POINT.items()) + " FROM fc GROUP BY cat_id", _EVAL))
def point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evaluated(spark, sf_dir)[1].groupBy("cat_id").agg(*(c.alias(n) for n, c in metrics.point().items())))


_DEV = "AVG(2 * (POWER(sales, 0.5) / (-0.5 * 0.5) - sales * POWER(GREATEST(f, 1e-6), -0.5) / -0.5 + POWER(GREATEST(f, 1e-6), 0.5) / 0.5))"


@register("objective_metric", on_split(f"SELECT {o.r(_POINT['rmse'], 4, 'rmse')}, {o.r(_DEV, 3, 'tweedie')} FROM fc", _EVAL))
def objective_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evaluated(spark, sf_dir)[1].agg(metrics.objective().alias("rmse"), metrics.objective("tweedie").alias("tweedie")), tweedie=3)


@register("naive_scale", on_split(f"SELECT series_id, {o.r('mse_scale', 3)}, {o.r('mae_scale')} FROM sc", f"{_EVAL}, {_SCALE}"))
def naive_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.naive_scales(_evaluated(spark, sf_dir)[0]), mse_scale=3)


@register("dollar_weights", on_split(f"SELECT series_id, {o.r('weight', 2)} FROM wt", f"{_EVAL}, {_SCALE}"))
def dollar_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.dollar_weights(_evaluated(spark, sf_dir)[0]), 2)


@register("rmsse_mase", on_split(f"SELECT series_id, {o.r('rmsse')}, {o.r('mase')} FROM ss", f"{_EVAL}, {_SCALE}"))
def rmsse_mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, done = _evaluated(spark, sf_dir)
    return rounded(metrics.scaled_by_series(done, metrics.naive_scales(known)))


@register("spec", on_split(f"SELECT series_id, {o.r('spec', 3)} FROM sp", f"{_EVAL}, {_SPEC}"))
def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.spec_by_series(_evaluated(spark, sf_dir)[1]), 3)


@register("evaluate_predictions", on_split("SELECT * FROM (SELECT " + ", ".join(o.r(e, 4, n) for n, e in _POINT.items()) + f" FROM fc) CROSS JOIN (SELECT {o.r(_wavg('rmsse'), 4, 'wrmsse')}, {o.r(_wavg('mase'), 4, 'mase')}, {o.r(_wavg('spec'), 3, 'spec')} FROM ss JOIN sp USING (series_id) LEFT JOIN wt USING (series_id))", f"{_EVAL}, {_SCALE}, {_SPEC}"))
def evaluate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, done = _evaluated(spark, sf_dir)
    return rounded(metrics.evaluate(known, done), spec=3)


_REPORT = "rp AS (SELECT *, round_even(f, 0) AS y_pred FROM fc)"


@register("predictions_report", on_split(f"SELECT series_id, date, {o.r('sales', 2)}, {o.r('gross_sales', 2)}, {o.r('y_pred * avg_sell_price', 2, 'gross_sales_pred')}, {o.r('y_pred', 2)}, {o.r('sales - y_pred', 2, 'error')}, {o.r('ABS(sales - y_pred)', 2, 'abs_error')}, {o.r('ABS(sales - y_pred) / NULLIF(ABS(sales), 0)', 4, 'wape')}, {o.r('(y_pred - sales) / NULLIF(ABS(sales), 0)', 4, 'bias')} FROM rp", f"{_EVAL}, {_REPORT}"))
def predictions_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.predictions_report(_evaluated(spark, sf_dir)[1]), 2, wape=4, bias=4)


@register("test_set_sink", on_split(f"SELECT series_id, {', '.join(DIMS)}, date, {o.r('sales', 2)}, {o.r('y_pred', 2, 'forecast')} FROM rp", f"{_EVAL}, {_REPORT}"))
def test_set_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions and forecasts of the test rows, as they are written and read back."""
    path = files.scratch(spark, "test_set")
    files.write_test_set(_evaluated(spark, sf_dir)[1], path)
    return rounded(spark.read.parquet(path), 2)


_LOGP = "LN(1 + GREATEST(y_pred, 0)) - LN(1 + GREATEST(sales, 0))"
_SERIES_SQL = f"""SELECT r.series_id, {o.b('COUNT(*)', 'n_days')}, {o.b('SUM(CASE WHEN sales > 0 THEN 1 ELSE 0 END)', 'n_days_with_sales')}, {o.r('SUM(sales)', 2, 'sales')}, {o.r('SUM(y_pred)', 2, 'y_pred')},
{o.r('SUM(sales - y_pred)', 2, 'error')}, {o.r('SUM(ABS(sales - y_pred))', 2, 'abs_error')}, {o.r('SUM(gross_sales)', 2, 'gross_sales')}, {o.r('SUM(gross_sales) / (SELECT SUM(gross_sales) FROM rp)', 4, 'gross_sales_pct')},
{o.r('SUM(ABS(sales - y_pred)) / NULLIF(SUM(ABS(sales)), 0)', 4, 'wape')}, {o.r('SUM(y_pred - sales) / NULLIF(SUM(ABS(sales)), 0)', 4, 'bias')}, {o.r(f'SQRT(AVG(({_LOGP}) * ({_LOGP})))', 4, 'rmsle')},
{o.r('COALESCE(SUM(sales - y_pred) / NULLIF(AVG(ABS(sales - y_pred)), 0), 0)', 4, 'tracking_signal')},
{o.r('SQRT(COALESCE(SUM((sales - y_pred) * (sales - y_pred) * gross_sales) / NULLIF(SUM(gross_sales), 0), AVG((sales - y_pred) * (sales - y_pred))) / NULLIF(MAX(mse_scale), 0))', 4, 'wrmsse')},
{o.r('AVG(ABS(sales - y_pred)) / NULLIF(MAX(mae_scale), 0)', 4, 'mase')}, {o.r('MAX(spec)', 3, 'spec')} FROM rp r LEFT JOIN sc ON r.series_id = sc.series_id JOIN sp ON r.series_id = sp.series_id GROUP BY 1"""


@register("series_metrics", on_split(_SERIES_SQL, f"{_EVAL}, {_SCALE}, {_REPORT}, {_SPEC.replace('SUM(f)', 'SUM(y_pred)').replace('x.f,', 'x.y_pred,').replace('FROM fc', 'FROM rp')}"))
def series_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, done = _evaluated(spark, sf_dir)
    money = {c: 2 for c in ("sales", "y_pred", "error", "abs_error", "gross_sales")}
    return rounded(metrics.series_metrics(known, metrics.predictions_report(done)), **money, spec=3)


# roll-ups and rankings --------------------------------------------------------------------------------------------------------
_UP = ("state", "cat", "state_cat")


def _levels_forecast(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Weekly naive forecasts of the test days at several levels, as they add up; and the known days of the total."""
    parts, s = [], _dates(spark, sf_dir)
    for name in _UP:
        df = plans.dense_base(spark, sf_dir, name, GRAIN)
        done = forecast.moving_average(df.where(F.col("date") < F.lit(s.test_start)), s.test(df), 28)
        parts.append(done.select(F.lit(name).alias("level"), "date", "sales", F.rint("forecast").alias("y_pred")))
    total = plans.dense_base(spark, sf_dir, "total", GRAIN)
    return functools.reduce(DataFrame.unionByName, parts), total.where(F.col("date") < F.lit(s.test_start))


def _up_sql() -> str:
    """Dense daily sales of several levels from the finest of them: sums of a dense panel are dense."""
    parts = []
    for name, cols in (("state", "state_id"), ("cat", "cat_id"), ("state_cat", "series_id")):
        parts.append(f"SELECT '{name}' AS level, {cols} AS series, date, SUM(sales) AS sales FROM p GROUP BY ALL")
    return f"""lv AS ({' UNION ALL '.join(parts)}), ts AS (SELECT MAX(date) - 27 AS test_start FROM p),
m AS (SELECT level, series, AVG(sales) AS f FROM (SELECT lv.*, ROW_NUMBER() OVER (PARTITION BY level, series ORDER BY date DESC) AS back FROM lv, ts WHERE date < test_start) WHERE back <= 28 GROUP BY ALL),
pr AS (SELECT lv.level, date, SUM(lv.sales) AS sales, SUM(round_even(f, 0)) AS y_pred FROM lv JOIN m ON lv.level = m.level AND lv.series = m.series, ts WHERE date >= test_start GROUP BY ALL)"""


@register("bottom_up_total", o.on_dense(LEVEL, GRAIN, _up_sql(), f"SELECT date, {o.r('MAX(sales)', 2, 'actual')}, " + ", ".join(o.r(f"MAX(CASE WHEN level = '{n}' THEN y_pred END)", 2, n) for n in _UP) + " FROM pr GROUP BY date"))
def bottom_up_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.bottom_up(_levels_forecast(spark, sf_dir)[0], list(_UP)), 2)


@register("total_metrics", o.on_dense(LEVEL, GRAIN, _up_sql() + ", tt AS (SELECT date, SUM(sales) AS sales FROM p, ts WHERE date < test_start GROUP BY 1), sc AS (SELECT AVG(x * x) AS scale FROM (SELECT sales - LAG(sales) OVER (ORDER BY date) AS x FROM tt))", f"SELECT level, {o.r('SUM(ABS(sales - y_pred)) / SUM(ABS(sales))', 4, 'wape')}, {o.r('SQRT(AVG((sales - y_pred) * (sales - y_pred))) / SQRT(MAX(scale))', 4, 'wrmsse')} FROM pr, sc GROUP BY level"))
def total_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, total = _levels_forecast(spark, sf_dir)
    return rounded(analytics.total_metrics(analytics.bottom_up(predictions, list(_UP)), list(_UP), total))


#: Results by supplier nation and year stand in for a table of models: model, level, grain, wape, wrmsse.
_RESULTS = """res AS (SELECT CASE WHEN s_nationkey % 3 = 0 THEN 'nation ' || s_nationkey || ' (bench)' ELSE 'nation ' || s_nationkey END AS model, CAST(year(l_shipdate) AS INTEGER) AS level, CASE WHEN month(l_shipdate) <= 6 THEN 'daily' ELSE 'weekly' END AS grain,
SUM(l_tax) / SUM(l_quantity) AS wape, SUM(l_discount) / COUNT(*) AS wrmsse FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star.read(spark, sf_dir, "lineitem")
    rows = lines.join(star.read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"), F.when(F.col("s_nationkey") % 3 == 0, F.lit(" (bench)")).otherwise(F.lit("")))
    keys = [name.alias("model"), F.year("l_shipdate").alias("level"), F.when(F.month("l_shipdate") <= 6, "daily").otherwise("weekly").alias("grain")]
    return rows.groupBy(*keys).agg((F.sum("l_tax") / F.sum("l_quantity")).alias("wape"), (F.sum("l_discount") / F.count("*")).alias("wrmsse"))


@register("avg_over_levels", f"WITH {_RESULTS} SELECT regexp_replace(model, ' [(]bench[)]$', '') AS model, grain, NOT regexp_matches(model, '[(]bench[)]$') AS tuned, {o.r('AVG(wape)', 6, 'wape')}, {o.r('AVG(wrmsse)', 6, 'wrmsse')}, {o.b('COUNT(DISTINCT level)', 'n_levels')} FROM res GROUP BY ALL")
def avg_over_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.averages_over_levels(_results(spark, sf_dir)), 6)


@register("winner_count", f"WITH {_RESULTS} SELECT model, {o.b('COUNT(*)', 'n')} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY level, grain ORDER BY ROUND(wrmsse, 9), model) AS k FROM res) WHERE k = 1 GROUP BY model")
def winner_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.winners(_results(spark, sf_dir).withColumn("wrmsse", F.round("wrmsse", 9)))


@register("importance_pct_rank", f"WITH i AS (SELECT p_type AS model, p_brand AS feature, CAST(SUM(p_size) AS DOUBLE) AS importance FROM part GROUP BY ALL) SELECT model, feature, importance, {o.r('importance / SUM(importance) OVER (PARTITION BY model)', 6, 'share')}, {o.i('ROW_NUMBER() OVER (PARTITION BY model ORDER BY importance DESC, feature)', 'rank')} FROM i")
def importance_pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("model"), F.col("p_brand").alias("feature")).agg(F.sum("p_size").cast("double").alias("importance"))
    return rounded(analytics.importance_ranks(rows), 6)


@register("top_k_per_group", f"WITH {o.STAR}, g AS (SELECT state_id, item_id, SUM(sales) AS sales FROM fact GROUP BY ALL) SELECT state_id, item_id, {o.r('sales', 2)}, {o.i('k', 'rank')} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY state_id ORDER BY sales DESC, item_id) AS k FROM g) WHERE k <= 10")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.sales(spark, sf_dir).groupBy("state_id", "item_id").agg(F.sum("sales").alias("sales"))
    return rounded(analytics.top_k(rows, ["state_id"], [F.desc("sales"), F.col("item_id")], 10), 2)


@register("nsmallest", f"WITH {o.STAR} SELECT item_id, {o.r('SUM(sales)', 2, 'sales')} FROM fact GROUP BY 1 ORDER BY SUM(fact.sales), item_id LIMIT 15")
def nsmallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(star.sales(spark, sf_dir).groupBy("item_id").agg(F.sum("sales").alias("sales")).orderBy("sales", "item_id").limit(15), 2)


@register("restock", on_split(f"SELECT series_id, date, {o.r('sales', 2)}, {o.r('y_pred', 2)}, {o.r('100 * (y_pred - sales) / NULLIF(sales, 0)', 4, 'error_pct')}, round_even(y_pred * 1.15::DOUBLE, 0) + 0.0 AS reorder, y_pred > 150 AS extra_shift FROM rp", f"{_EVAL}, {_REPORT}"))
def restock(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.predictions_report(_evaluated(spark, sf_dir)[1]).select(*K, "sales", "y_pred")
    return rounded(analytics.restock(report, shift_above=150.0), 2, error_pct=4)


@register("sample_rows", "SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 500")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sample(star.read(spark, sf_dir, "orders"), ["o_orderkey"], 500)


# models -----------------------------------------------------------------------------------------------------------------------
_MODEL_COLUMNS = ("price_vs_mean", "snap", "month", "dayofweek", "weekofyear", "is_weekend", "dow_sin", "dow_cos", "doy_sin", "doy_cos", "days_to_event", "te_cat_mean", "pct_zero_28", "lag28", "rolling_mean_lag28_window_size28", "rolling_std_lag28_window_size28", "momentum_lag28_7_28", "rolling_mean_lag91_window_size91")


def _model_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, split.Split, list[str], list[str]]:
    """Train, masked validation and masked test rows of a level with what models see; written once, as every fit reads it."""
    df, s = _dense(spark, sf_dir, "cat"), _dates(spark, sf_dir)
    own = features.lag_features(features.derived_features(df), GRAIN, only="^(" + "|".join(c for c in _MODEL_COLUMNS if "lag" in c) + ")$")
    path = files.scratch(spark, "frames")
    split.masked_split(own.select(*K, "cat_id", "sales", "gross_sales", "avg_sell_price", "is_store_closed", *_MODEL_COLUMNS), s, GRAIN).write.parquet(path)
    rows = spark.read.parquet(path)
    train, valid, test = (rows.where(F.col("split") == x) for x in ("train", "valid", "test"))
    names, categories = [*_MODEL_COLUMNS, "cat_id"], ["cat_id"]
    return train, valid, test, s, learn.usable(train, names, categories), categories


@register("ml_bench")
def ml_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family with its defaults, and the winner, on the validation year."""
    train, valid, _, _, names, categories = _model_frames(spark, sf_dir)
    rows = learn.bench(train, valid, names, categories, ("gbt", "forest", "ridge", "tweedie"))
    best = learn.winner(rows)
    return spark.createDataFrame([(r["family"], r["score"], r["wape"], r["family"] == best) for r in rows], "family string, score double, wape double, winner boolean")


@register("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid, _, _, names, categories = _model_frames(spark, sf_dir)
    model = learn.fit(train, names, categories, "gbt")  # a family that sees the categories
    found = learn.permutation_importance(model, valid, names, categories)
    return spark.createDataFrame(list(found.items()), "feature string, importance double")


@register("backward_elimination")
def backward_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of attempts with a linear model."""
    train, valid, _, _, names, categories = _model_frames(spark, sf_dir)
    names = [n for n in names if n not in categories]  # a linear model sees no categories
    train, valid = train.cache(), valid.cache()
    evaluate = lambda chosen: learn.score(learn.predict(learn.fit(train, chosen, [], "ridge"), valid, chosen, []))
    importance = learn.permutation_importance(learn.fit(train, names, [], "ridge"), valid, names, [])
    _, _, log = learn.eliminate(names, importance, evaluate, 0.02, 4)
    train.unpersist(), valid.unpersist()
    return spark.createDataFrame([(r["n_features"], r["score"], r["removed"], r["n_removed"], r["accepted"]) for r in log], "n_features int, score double, removed string, n_removed int, accepted boolean")


@register("search_and_final_fit")
def search_and_final_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small search, folds, the final fit on train and validation, and its test errors beside the weekly naive forecast."""
    train, valid, test, s, names, categories = _model_frames(spark, sf_dir)
    evaluate = lambda p: learn.score(learn.predict(learn.fit(train, names, categories, "ridge", p), valid, names, categories))
    best, _, _ = learn.search(learn.FAMILIES["ridge"].space, evaluate, 4)  # its space has three values beside the defaults
    folds = [(a, b) for a, b in split.rolling_folds(train, s, GRAIN, 2)[:1]] + [(train, valid)]
    model, params, _ = learn.final_fit(train, valid, folds, names, categories, "ridge", best)
    done = learn.predict(model, test, names, categories).select(*K, "sales", "forecast", F.lit("ridge").alias("model"))
    known = train.unionByName(valid)
    naive = metrics.clip_closed(forecast.seasonal_naive(known, test, 7)).select(*K, "sales", "forecast", F.lit("seasonal_naive_7").alias("model"))
    return done.unionByName(naive).groupBy("model").agg(*(c.alias(n) for n, c in metrics.point().items()))


@register("regression_gate", "WITH v AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS key, strftime(o_orderdate, '%Y%m') AS version, AVG(o_totalprice) AS wrmsse_test, MAX(o_totalprice) AS wape_test FROM orders GROUP BY ALL), l AS (SELECT *, LAG(wrmsse_test) OVER w AS a, LAG(wape_test) OVER w AS z, LEAD(version) OVER w IS NULL AS last FROM v WINDOW w AS (PARTITION BY key ORDER BY version)) SELECT key, version, CAST(COALESCE(CAST(wrmsse_test > a * 1.05::DOUBLE AS INTEGER), 0) + COALESCE(CAST(wape_test > z * 1.05::DOUBLE AS INTEGER), 0) AS INTEGER) AS violations FROM l WHERE last")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).cast("string").alias("key"), F.date_format("o_orderdate", "yyyyMM").alias("version")).agg(F.avg("o_totalprice").alias("wrmsse_test"), F.max("o_totalprice").alias("wape_test"))
    return registry.regression_table(rows)


@register("list_levels", "SELECT * FROM (VALUES (3, 'cat', 'daily', '20240102T000000Z', 2), (3, 'cat', 'weekly', '20240101T000000Z', 1), (12, 'item_store', 'daily', '20240103T000000Z', 1)) t(level, name, grain, latest, versions)")
def list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's levels, after its table was lost and filled again from the artifacts."""
    kept = registry.Registry(files.scratch(spark, "registry"), spark)
    for level, grain, version in ((3, "daily", "20240101T000000Z"), (3, "daily", "20240102T000000Z"), (3, "weekly", "20240101T000000Z"), (12, "daily", "20240103T000000Z")):
        kept.add(registry.Artifact(level, grain, "sales", "ridge", ["n"], {}, "1998-01-01"), version=version)
    kept.folder.write("registry.json", "{}")
    kept.backfill()
    rows = [(r["level"], r["name"], r["grain"], r["latest"], r["versions"]) for r in kept.levels()]
    return spark.createDataFrame(rows, "level int, name string, grain string, latest string, versions int")


@register("build_target_row")
def build_target_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The featured row of the day after the panel's last one."""
    panel = _dense(spark, sf_dir, "cat", "weekly")
    last = panel.orderBy(F.desc("date"), "series_id").first()
    return serve.target_rows(panel, "weekly", last.series_id, last.date + dt.timedelta(days=7), {"avg_sell_price": 1500.0}, features.featured)


_NN = ("avg_sell_price", "price_vs_mean")
_NN_SQL = f"""med AS (SELECT {', '.join(f'MEDIAN({c}) AS {c}_m' for c in _NN)} FROM train), fil AS (SELECT {', '.join(f'COALESCE({c}, {c}_m) AS {c}' for c in _NN)} FROM train, med),
mom AS (SELECT {', '.join(f'AVG({c}) AS {c}_a, STDDEV_POP({c}) AS {c}_d' for c in _NN)} FROM fil),
ev AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) AS k FROM (SELECT DISTINCT COALESCE(event_name_1, '__MISSING__') AS v FROM train))"""


@register("nn_preprocess", on_split(f"SELECT series_id, date, {o.i('COALESCE(k, 0)', 'event_name_1')}, " + ", ".join(o.r(f"COALESCE((COALESCE({c}, {c}_m) - {c}_a) / NULLIF({c}_d, 0), 0)", 4, c) for c in _NN) + f", {o.r('LN(1 + GREATEST(sales, 0))', 4, 'target')} FROM valid CROSS JOIN med CROSS JOIN mom LEFT JOIN ev ON COALESCE(event_name_1, '__MISSING__') = v", _NN_SQL))
def nn_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    return rounded(learn.tabular_inputs(s.train(df), s.valid(df), list(_NN), ["event_name_1"]))


@register("clip_closed_pred", on_split(f"SELECT series_id, date, {o.r('CASE WHEN is_store_closed = 1 THEN 0 ELSE COALESCE(m, 0) END', 4, 'forecast')} FROM valid LEFT JOIN (SELECT series_id, AVG(sales) AS m FROM train GROUP BY 1) USING (series_id)"))
def clip_closed_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = _split(spark, sf_dir)
    return rounded(metrics.clip_closed(forecast.historical_mean(s.train(df), s.valid(df))).select(*K, "forecast"))


@register("melt", f"WITH {_RESULTS} SELECT model, level, grain, 'wape' AS metric, {o.r('wape', 6, 'value')} FROM res UNION ALL SELECT model, level, grain, 'wrmsse', {o.r('wrmsse', 6, 'value')} FROM res")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).unpivot(["model", "level", "grain"], ["wape", "wrmsse"], "metric", "value")
    return rounded(rows, 6)


@register("str_split_expand", "SELECT p_type || '_' || p_brand AS both, p_type AS a, p_brand AS b, CAST(COUNT(*) AS BIGINT) AS n FROM part GROUP BY ALL")
def str_split_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type has no underscore: the first part is the type, the last the brand."""
    both = star.read(spark, sf_dir, "part").select(F.concat_ws("_", "p_type", "p_brand").alias("both"))
    return both.groupBy("both").agg(F.count("*").alias("n")).select("both", F.split("both", "_")[0].alias("a"), F.element_at(F.split("both", "_"), -1).alias("b"), "n")


@register("downcast", f"WITH {o.STAR}, {o.sparse('cat', 'weekly')} SELECT series_id, first AS date, CAST(CAST(ROUND(sales, 0) AS FLOAT) AS DOUBLE) AS sales FROM base")
def downcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plans.aggregate(star.joined(spark, sf_dir), plans.BY_NAME["cat"], "weekly").select(*K, "sales")
    return features.downcast(rows).withColumn("sales", F.round("sales").cast("double"))


@register("all_series_metrics", on_split("SELECT model, series_id, " + o.r("SUM(ABS(sales - g)) / NULLIF(SUM(ABS(sales)), 0)", 4, "wape") + ", " + o.r("SUM(g - sales) / NULLIF(SUM(ABS(sales)), 0)", 4, "bias") + " FROM (SELECT 'seasonal_naive_7' AS model, series_id, sales, f AS g FROM fc UNION ALL SELECT 'historical_mean', t.series_id, sales, CASE WHEN is_store_closed = 1 THEN 0 ELSE m END FROM test t JOIN (SELECT series_id, AVG(sales) AS m FROM known GROUP BY 1) USING (series_id)) GROUP BY ALL", _EVAL))
def all_series_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grouped sum over all models' rows."""
    df, s = _split(spark, sf_dir)
    known, test = df.where(F.col("date") < F.lit(s.test_start)), s.test(df)
    runs = {"seasonal_naive_7": forecast.seasonal_naive(known, test, 7), "historical_mean": forecast.historical_mean(known, test)}
    rows = functools.reduce(DataFrame.unionByName, (metrics.clip_closed(x).select(F.lit(k).alias("model"), "series_id", "sales", "forecast") for k, x in runs.items()))
    measures = metrics.point()
    return rounded(rows.groupBy("model", "series_id").agg(measures["wape"].alias("wape"), measures["bias"].alias("bias")))
