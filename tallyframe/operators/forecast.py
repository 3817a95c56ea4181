"""Naive and classical forecasts of a panel: each takes train and valid and returns valid with a ``forecast`` column."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import by_date, div

SERIES = "series_id"


def _latest() -> Column:
    return F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc("date")))


def last_rows(train: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series, with back = 1 for the last."""
    return train.withColumn("back", _latest()).where(F.col("back") <= n)


def step_ahead() -> Column:
    """1 for a series' first row."""
    return F.row_number().over(by_date())


def seasonal_naive(train: DataFrame, valid: DataFrame, season: int, target: str = "sales") -> DataFrame:
    """The last season, repeated; 0 for a series that train doesn't have."""
    tail = last_rows(train, season).select(SERIES, "back", F.col(target).alias("forecast"))
    size = tail.groupBy(SERIES).agg(F.max("back").cast("int").alias("__n"))
    rows = valid.withColumn("__k", step_ahead() - 1).join(size, SERIES, "left").withColumn("back", F.col("__n") - F.pmod("__k", "__n"))
    return rows.join(tail, [SERIES, "back"], "left").withColumn("forecast", F.coalesce("forecast", F.lit(0.0))).drop("__k", "__n", "back")


def _per_series(train: DataFrame, valid: DataFrame, value: Column) -> DataFrame:
    stat = train.groupBy(SERIES).agg(value.alias("forecast"))
    return valid.join(stat, SERIES, "left").withColumn("forecast", F.coalesce("forecast", F.lit(0.0)))


def drift(train: DataFrame, valid: DataFrame, target: str = "sales") -> DataFrame:
    """The line through the first and the last value, continued."""
    ends = train.groupBy(SERIES).agg(F.min_by(target, "date").alias("__a"), F.max_by(target, "date").alias("__b"), F.count("*").alias("__n"))
    slope = F.when(F.col("__n") > 1, div(F.col("__b") - F.col("__a"), F.col("__n") - 1)).otherwise(F.lit(0.0))
    rows = valid.withColumn("__h", step_ahead()).join(ends, SERIES, "left")
    return rows.withColumn("forecast", F.coalesce(F.col("__b") + F.col("__h") * slope, F.lit(0.0))).drop("__a", "__b", "__n", "__h")


def historical_mean(train: DataFrame, valid: DataFrame, target: str = "sales") -> DataFrame:
    return _per_series(train, valid, F.avg(target))


def moving_average(train: DataFrame, valid: DataFrame, window: int, target: str = "sales") -> DataFrame:
    return _per_series(last_rows(train, window), valid, F.avg(target))


# classical models: one series at a time, in numpy -----------------------------------------------------------------------------
def sane(forecast: np.ndarray, known: np.ndarray, ratio: float = 50.0) -> bool:
    """Finite, and within ``ratio`` times the largest known value."""
    return bool(np.isfinite(forecast).all() and (np.abs(forecast) <= ratio * max(np.abs(known).max(), 1.0)).all())


def forecast_by_series(train: DataFrame, valid: DataFrame, fit: Callable[[np.ndarray, int], np.ndarray], target: str = "sales") -> DataFrame:
    """fit(known values, steps) for each series. The last value is repeated where that fails or gives no sane forecast; 0 without train."""

    def run(known: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        ahead = ahead.sort_values("date")
        y = known.sort_values("k_date")["y"].to_numpy(float)
        if not len(y):
            return ahead[[SERIES, "date"]].assign(forecast=0.0)
        try:
            with np.errstate(all="raise"):
                out = np.asarray(fit(y, len(ahead)), float)
            if out.shape != (len(ahead),) or not sane(out, y):
                raise ValueError("no sane forecast")
        except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError):
            out = np.full(len(ahead), y[-1])
        return ahead[[SERIES, "date"]].assign(forecast=out)

    # names of their own: both sides often come from one panel
    past = train.select(F.col(SERIES).alias("k_series"), F.col("date").alias("k_date"), F.col(target).alias("y")).groupBy("k_series")
    found = past.cogroup(valid.select(F.col(SERIES).alias(SERIES), F.col("date").alias("date")).groupBy(SERIES)).applyInPandas(run, f"{SERIES} string, date date, forecast double")
    return valid.join(found, [SERIES, "date"], "left")


def holt_winters(season: int, rates: tuple[float, ...] = (0.05, 0.2, 0.5)) -> Callable[[np.ndarray, int], np.ndarray]:
    """Additive level, trend and season; rates chosen from a grid by the squared one-step error. The grid runs along the series at once."""
    a, b, g = np.array(list(itertools.product(rates, (0.01, 0.1), rates))).T

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        if len(y) < 2 * season:
            raise ValueError("shorter than two seasons")
        level, trend = np.full(len(a), y[:season].mean()), np.full(len(a), (y[season : 2 * season].mean() - y[:season].mean()) / season)
        seasons, error = np.repeat((y[:season] - y[:season].mean())[:, None], len(a), axis=1), np.zeros(len(a))
        for t in range(season, len(y)):
            s, before = seasons[t % season], level + trend
            error += (y[t] - before - s) ** 2
            old, level = level, a * (y[t] - s) + (1 - a) * before
            trend = b * (level - old) + (1 - b) * trend
            seasons[t % season] = g * (y[t] - level) + (1 - g) * s
        best = int(error.argmin())
        k = np.arange(1, h + 1)
        return level[best] + k * trend[best] + seasons[(len(y) - 1 + k) % season, best]

    return fit


def theta(season: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """Seasonally adjusted by means, then the average of a straight line and exponential smoothing of the doubled curvature."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        n = len(y)
        if n < 2 * season:
            raise ValueError("shorter than two seasons")
        t = np.arange(n)
        index = np.array([y[t % season == k].mean() for k in range(season)]) - y.mean()
        flat = y - index[t % season]
        slope, base = np.polyfit(t, flat, 1)
        curve = 2 * flat - (base + slope * t)

        def smooth(a: float) -> tuple[float, float]:
            level, error = curve[0], 0.0
            for x in curve[1:]:
                error += (x - level) ** 2
                level += a * (x - level)
            return error, level

        _, level = min((smooth(a) for a in (0.05, 0.1, 0.2, 0.4, 0.8)), key=lambda x: x[0])
        k = n + np.arange(h)
        return (base + slope * k + level) / 2 + index[k % season]

    return fit


def seasonal_arima(season: int, rounds: int = 12) -> Callable[[np.ndarray, int], np.ndarray]:
    """(1, 1, 1)(1, 1, 1): the four coefficients by conditional least squares.

    A long autoregression gives first shocks and a regression on them first coefficients; Gauss-Newton steps on the sum of squared
    shocks, halved until they help, do the rest.
    """

    def lagged(w: np.ndarray, e: np.ndarray, t: int, p: np.ndarray) -> float:
        """What is expected at t: both polynomials multiplied out."""
        a, s, b, m = p
        return a * w[t - 1] + s * w[t - season] - a * s * w[t - season - 1] + b * e[t - 1] + m * e[t - season] + b * m * e[t - season - 1]

    def shocks_of(w: np.ndarray, p: np.ndarray) -> np.ndarray:
        e = np.zeros(len(w))
        for t in range(season + 1, len(w)):
            e[t] = w[t] - lagged(w, e, t, p)
        return e

    def start(w: np.ndarray, long: int) -> np.ndarray:
        past = np.column_stack([w[long - k : len(w) - k] for k in range(1, long + 1)])
        gram = past.T @ past
        e = np.r_[np.zeros(long), w[long:] - past @ np.linalg.solve(gram + 1e-4 * np.trace(gram) / long * np.eye(long), past.T @ w[long:])]
        terms = np.column_stack([x[long - k : len(w) - k] for x in (w, e) for k in (1, season)])
        return np.linalg.lstsq(terms, w[long:], rcond=None)[0].clip(-0.95, 0.95)

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        w = np.diff(y)
        w = w[season:] - w[:-season]
        long = min(2 * season + 2, len(w) // 4)
        if long < season + 2:
            raise ValueError("too short")
        p = start(w, long)
        e = shocks_of(w, p)
        for _ in range(rounds):
            slope = np.column_stack([(shocks_of(w, p + 1e-4 * way) - e) / 1e-4 for way in np.eye(4)])
            gram = slope.T @ slope
            move = np.linalg.solve(gram + (1e-6 * np.trace(gram) + 1e-12) * np.eye(4), slope.T @ e)
            tried = ((q, shocks_of(w, q)) for q in ((p - move / 2**k).clip(-0.98, 0.98) for k in range(6)))
            better = next(((q, x) for q, x in tried if x @ x < e @ e * (1 - 1e-6)), None)
            if better is None:
                break
            p, e = better
        w, e, z = np.r_[w, np.zeros(h)], np.r_[e, np.zeros(h)], list(y)
        for t in range(len(w) - h, len(w)):
            w[t] = lagged(w, e, t, p)
            z.append(z[-1] + z[-season] - z[-season - 1] + w[t])
        return np.array(z[len(y) :])

    return fit


def harmonic_regression(periods: tuple[float, ...] = (7.0, 365.25), order: int = 3) -> Callable[[np.ndarray, int], np.ndarray]:
    """A trend and Fourier terms by least squares: stands in for additive decomposition models with several seasons."""

    def design(t: np.ndarray, n: int) -> np.ndarray:
        waves = [f(2 * np.pi * k * t / p) for p in periods for k in range(1, order + 1) for f in (np.sin, np.cos)]
        return np.column_stack([np.ones(len(t)), t / n, *waves])

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        n = len(y)
        x = design(np.arange(n), n)
        beta = np.linalg.solve(x.T @ x + 1e-6 * n * np.eye(x.shape[1]), x.T @ y)
        return design(np.arange(n, n + h), n) @ beta

    return fit
