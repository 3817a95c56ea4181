"""Serving: rows as a model expects them, and the row of a day to come built by the training features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.config import PRICE_LAG
from tallyframe.functions import div
from tallyframe.operators.learn import predict
from tallyframe.operators.registry import Registry

OVERRIDES = ("avg_sell_price", "snap", "event_name_1", "event_type_1", "event_name_2", "event_type_2")


class BadRow(ValueError):
    """The payload doesn't fit the model: status 400."""


def feature_row(payload: dict, features: list[str], categories: dict[str, list[str]]) -> dict:
    """The payload's values in the model's order. Names have to be the model's exactly, numbers numbers, and categories known ones."""
    missing, extra = sorted(set(features) - set(payload)), sorted(set(payload) - set(features))
    if missing or extra:
        raise BadRow({"missing": missing, "extra": extra})
    out = {}
    for name in features:
        value = payload[name]
        if name in categories:
            value = value if value is None or value in categories[name] else None
        elif value is not None:
            if isinstance(value, (bool, str)):
                try:
                    value = float(value)
                except ValueError:
                    raise BadRow({"not a number": [name]}) from None
            value = float(value)
        out[name] = value
    return out


def health() -> dict:
    return {"status": "ok"}


def target_rows(history: DataFrame, grain: str, series: str, date: dt.date, overrides: dict | None, features: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The featured row of a series at a date: its level's history up to the day before, one row more, and the training features.

    The price is carried forward and there is no event, unless overrides say otherwise. history: a panel with exogenous columns.
    """
    overrides = dict(overrides or {})
    if unknown := sorted(set(overrides) - set(OVERRIDES)):
        raise ValueError(f"not to be overridden: {unknown}")
    history = history.where(F.col("date") < F.lit(date))
    own = history.where(F.col("series_id") == series)
    last = own.orderBy(F.desc("date")).limit(PRICE_LAG[grain]).collect()
    if not last:
        raise KeyError(f"{series!r} has no history before {date}")
    price = overrides.get("avg_sell_price", last[0].avg_sell_price)
    n = PRICE_LAG[grain]
    lagged = last[n - 1].avg_sell_price if len(last) >= n else None
    mean = own.agg(F.avg("avg_sell_price").alias("m")).first().m
    iso = date.isocalendar()
    values = last[0].asDict() | {
        "date": date, "sales": 0.0, "gross_sales": None, "avg_sell_price": price, f"price_lag_{n}": lagged,
        "price_change": price / lagged - 1 if price is not None and lagged else None, "price_vs_mean": price / mean if price is not None and mean else None,
        "snap": overrides.get("snap", 0), **{c: overrides.get(c) for c in OVERRIDES if c.startswith("event")},
        "has_event": int(overrides.get("event_name_1") is not None), "has_event_2": int(overrides.get("event_name_2") is not None),
        "year": date.year, "month": date.month, "day": date.day, "dayofweek": iso.weekday, "weekofyear": iso.week, "is_weekend": int(iso.weekday >= 6),
    }
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in history.schema)  # without the panel's not-null marks
    row = history.sparkSession.createDataFrame([tuple(values[c] for c in history.columns)], schema)
    return features(history.unionByName(row), grain).where((F.col("series_id") == series) & (F.col("date") == F.lit(date)))


def forecast(registry: Registry, rows: DataFrame, level: int, target: str = "sales", version: str | None = None, grain: str | None = None) -> tuple[DataFrame, dict]:
    """rows with a forecast by the resolved model, and which one that was."""
    key, version, path = registry.resolve(level, target, version, grain)
    artifact = registry.artifact(path)
    missing = [f for f in artifact.features if f not in rows.columns]
    if missing:
        raise BadRow({"missing": missing, "extra": []})
    done = predict(registry.model(path), rows, artifact.features, list(artifact.categories))
    return done, {"key": key, "version": version, "grain": artifact.grain, "family": artifact.family}


def price_lags(history: DataFrame, price: str = "avg_sell_price") -> DataFrame:
    """Each series' mean price and its last: what a row to come is compared with."""
    return history.groupBy("series_id").agg(F.avg(price).alias("mean_price"), F.max_by(price, "date").alias("last_price")).withColumn("ratio", div("last_price", "mean_price"))
