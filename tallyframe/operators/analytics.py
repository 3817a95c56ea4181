"""Questions about a panel: shares, pivots, demand classes, event effects, roll-ups and profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.config import ADI_CUT, CV2_CUT
from tallyframe.functions import div
from tallyframe.operators.metrics import naive_scales, point

SERIES = "series_id"


def share_of(value: Column | str, *parent: str) -> Column:
    """Of grouped rows: value by its sum over parent (all rows without one)."""
    return div(value, F.sum(value).over(Window.partitionBy(*parent)))


def group_share(df: DataFrame, by: list[str], parent: list[str], value: str = "sales") -> DataFrame:
    """Sum by ``by`` and its share of ``parent``."""
    total = df.groupBy(*by).agg(F.sum(value).alias(value))
    return total.withColumn("share", share_of(value, *parent))


def pivot_sum(df: DataFrame, row: str, column: str, values: list, value: str = "sales") -> DataFrame:
    """A row for each ``row``, a column for each of values: no pass to find them."""
    return df.groupBy(row).pivot(column, values).agg(F.sum(value)).na.fill(0)


def demand_classes(df: DataFrame) -> DataFrame:
    """series_id, n_days, n_sold, mean and deviation of sales above zero, adi, cv2, demand: smooth, intermittent, erratic or lumpy."""
    sold = F.when(F.col("sales") > 0, F.col("sales"))
    own = df.groupBy(SERIES).agg(F.count("*").alias("n_days"), F.count(sold).alias("n_sold"), F.avg(sold).alias("mean_sold"), F.stddev_samp(sold).alias("std_sold"))
    ratio = div("std_sold", "mean_sold")
    own = own.withColumns({"adi": div(F.col("n_days").cast("double"), F.col("n_sold")), "cv2": ratio * ratio})
    often, steady = F.col("adi") < ADI_CUT, F.col("cv2") < CV2_CUT
    rare, wild = F.col("adi") >= ADI_CUT, F.col("cv2") >= CV2_CUT
    return own.withColumn("demand", F.when(often & steady, "smooth").when(rare & steady, "intermittent").when(often & wild, "erratic").when(rare & wild, "lumpy"))


def class_summary(classes: DataFrame) -> DataFrame:
    """For each demand class: series, means and the class's share."""
    rows = classes.where("demand is not null").groupBy("demand").agg(F.count("*").alias("series"), F.avg("n_days").alias("n_days"), F.avg("n_sold").alias("n_sold"), F.avg("mean_sold").alias("mean_sold"), F.avg("adi").alias("adi"), F.avg("cv2").alias("cv2"))
    return rows.withColumn("share", share_of(F.col("series").cast("double")))


def representatives(classes: DataFrame) -> DataFrame:
    """Of each class, the series whose number of selling days is nearest to the class's median; ties go to the first by name."""
    one = Window.partitionBy("demand")
    rows = classes.where("demand is not null").withColumn("gap", F.abs(F.col("n_sold") - F.median("n_sold").over(one)))
    return rows.withColumn("__k", F.row_number().over(one.orderBy("gap", SERIES))).where("__k = 1").drop("__k")


def event_counts(df: DataFrame) -> DataFrame:
    return df.where("event_name is not null").groupBy("event_name", "event_type").agg(F.count("*").alias("n"))


def event_lift(df: DataFrame) -> DataFrame:
    """Mean daily sales at each event against days without one."""
    daily = df.groupBy("date", "event_name").agg(F.sum("sales").alias("sales"))
    normal = daily.where("event_name is null").agg(F.avg("sales").alias("normal"))
    own = daily.where("event_name is not null").groupBy("event_name").agg(F.count("*").alias("n_days"), F.avg("sales").alias("at_event"))
    return own.join(F.broadcast(normal)).select("event_name", "n_days", "at_event", "normal", (100 * (div("at_event", "normal") - 1)).alias("pct_change"))


def event_pre_post(df: DataFrame, days: int = 3) -> DataFrame:
    """Each event day beside the mean of the days before and after. Offsets are unfolded, so the join is on equal dates."""
    daily = df.groupBy("date").agg(F.sum("sales").alias("sales"), F.max("event_name").alias("event_name"))
    near = daily.where("event_name is not null").select("event_name", F.col("date").alias("event_date"), F.col("sales").alias("at_event"), F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("off"))
    met = near.withColumn("date", F.expr("date_add(event_date, off)")).join(daily.select("date", "sales"), "date")
    own = met.groupBy("event_name", "event_date", "at_event").agg(F.avg(F.when(F.col("off") < 0, F.col("sales"))).alias("pre"), F.avg(F.when(F.col("off") > 0, F.col("sales"))).alias("post"))
    return own.select("event_name", "event_date", "pre", "at_event", "post", (100 * (div("at_event", "pre") - 1)).alias("pct_vs_pre"), (100 * (div("post", "at_event") - 1)).alias("pct_post"))


def as_daily(df: DataFrame, value: str = "sales") -> DataFrame:
    """date, value for every day from the first to the last; null where there was none."""
    total = df.groupBy("date").agg(F.sum(value).alias(value))
    days = total.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return days.join(total, "date", "left")


def total_rolling(df: DataFrame, widths: tuple[int, ...] = (7, 28, 364)) -> DataFrame:
    """Total by date, and means over full windows. One row a day, so one partition is enough for the window."""
    total = df.groupBy("date").agg(F.sum("sales").alias("sales"))
    rows = Window.partitionBy(F.lit(1)).orderBy("date")
    means = {f"mean_{w}": F.when(F.count("sales").over(rows.rowsBetween(1 - w, 0)) == w, F.avg("sales").over(rows.rowsBetween(1 - w, 0))) for w in widths}
    return total.withColumns(means)


def autocorrelation(df: DataFrame, lags: tuple[int, ...] = (1, 7, 28, 364)) -> DataFrame:
    """lag, acf of the daily total."""
    total = df.groupBy("date").agg(F.sum("sales").alias("sales"))
    rows = Window.partitionBy(F.lit(1)).orderBy("date")
    wide = total.withColumns({f"l{k}": F.lag("sales", k).over(rows) for k in lags})
    return wide.agg(*(F.corr("sales", f"l{k}").alias(f"l{k}") for k in lags)).unpivot([], [f"l{k}" for k in lags], "name", "acf").select(F.expr("cast(substr(name, 2) as int)").alias("lag"), "acf")


def partial_autocorrelation(df: DataFrame, most: int = 28) -> DataFrame:
    """lag, pacf of the daily total, for lags 1 to ``most``, by the recursion of Durbin and Levinson over its autocorrelations.

    The autocorrelations are those about the whole mean, divided by the number of days, so the recursion is stable. They are ``most``
    sums of one pass; the recursion is on the driver.
    """
    total = df.groupBy("date").agg(F.sum("sales").alias("sales"))
    rows = Window.partitionBy(F.lit(1)).orderBy("date")
    centred = total.withColumn("x", F.col("sales") - F.avg("sales").over(Window.partitionBy(F.lit(1))))
    products = centred.select(*((F.col("x") * (F.lag("x", k).over(rows) if k else F.col("x"))).alias(f"g{k}") for k in range(most + 1)))
    gamma = products.agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in range(most + 1))).first()
    rho = [g / gamma[0] if gamma[0] and g is not None else 0.0 for g in gamma]
    out, phi, left = [], [], 1.0
    for k in range(1, most + 1):
        last = (rho[k] - sum(p * rho[k - 1 - j] for j, p in enumerate(phi))) / left if left > 1e-12 else 0.0
        phi = [p - last * phi[k - 2 - j] for j, p in enumerate(phi)] + [last]
        left *= 1 - last * last
        out.append((k, float(last)))
    return df.sparkSession.createDataFrame(out, "lag int, pacf double")


def _smoothed(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: int, weights: np.ndarray) -> np.ndarray:
    """Loess of degree 1: at each place, a line through the ``width`` nearest points by tricube weights. x is 0, 1, 2, ..."""
    n = len(x)
    near = min(width, n)
    first = np.clip(np.floor(at - (near - 1) / 2).astype(int), 0, n - near)
    index = first[:, None] + np.arange(near)
    away = np.abs(x[index] - at[:, None])
    reach = away.max(axis=1, keepdims=True) * max(1.0, width / n) + 1e-9
    w = weights[index] * np.clip(1 - (away / reach) ** 3, 0, None) ** 3
    sums = np.maximum(w.sum(axis=1), 1e-300)
    mx, my = (w * x[index]).sum(axis=1) / sums, (w * y[index]).sum(axis=1) / sums
    dx = x[index] - mx[:, None]
    slope = (w * dx * (y[index] - my[:, None])).sum(axis=1) / np.maximum((w * dx * dx).sum(axis=1), 1e-12)
    return my + slope * (at - mx)


def seasonal_trend(values: np.ndarray, season: int, seasonal_width: int = 7, inner: int = 2, robust: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal, trend and rest of a series by STL (Cleveland et al., 1990): loess over each phase, low-pass filter, loess of the trend."""
    y = np.asarray(values, float)
    n = len(y)
    if n < 2 * season:
        trend = np.full(n, y.mean() if n else 0.0)
        return np.zeros(n), trend, y - trend
    odd = lambda v: int(v) + 1 - int(v) % 2
    trend_width, low_width = odd(np.ceil(1.5 * season / (1 - 1.5 / seasonal_width))), odd(season)
    weights, trend, seasonal, t = np.ones(n), np.zeros(n), np.zeros(n), np.arange(n, dtype=float)
    moved = lambda v, w: np.convolve(v, np.ones(w) / w, "valid")
    for outer in range(robust + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * season)
            for phase in range(season):
                own, w = (y - trend)[phase::season], weights[phase::season]
                cycle[phase::season] = _smoothed(np.arange(len(own), dtype=float), own, np.arange(-1, len(own) + 1, dtype=float), seasonal_width, w)[: len(cycle[phase::season])]
            low = moved(moved(moved(cycle, season), season), 3)
            low = _smoothed(np.arange(len(low), dtype=float), low, np.arange(len(low), dtype=float), low_width, np.ones(len(low)))
            seasonal = cycle[season : season + n] - low[:n]
            trend = _smoothed(t, y - seasonal, t, trend_width, weights)
        rest = y - seasonal - trend
        if outer < robust:
            bound = 6 * np.median(np.abs(rest)) + 1e-12
            weights = np.clip(1 - np.minimum(np.abs(rest) / bound, 1) ** 2, 0, None) ** 2
    return seasonal, trend, y - seasonal - trend


def stl(df: DataFrame, season: int = 7, value: str = "sales", key: str = "series_id", robust: int = 0) -> DataFrame:
    """key, date, value, seasonal, trend, rest: each series apart, in order of date. A series is one group; it has a row a period."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("date")
        seasonal, trend, rest = seasonal_trend(own[value].to_numpy(), season, robust=robust)
        return own.assign(seasonal=seasonal, trend=trend, rest=rest)

    rows = df.select(key, "date", F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandas(run, f"{key} string, date date, {value} double, seasonal double, trend double, rest double")


def decomposition(df: DataFrame, season: int = 7) -> DataFrame:
    """date, sales, trend (centred mean), seasonal (mean departure of the weekday) and rest, of the daily total."""
    total = df.groupBy("date").agg(F.sum("sales").alias("sales"))
    half = season // 2
    rows = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-half, half)
    total = total.withColumn("trend", F.when(F.count("sales").over(rows) == 2 * half + 1, F.avg("sales").over(rows)))
    total = total.withColumn("seasonal", F.avg(F.col("sales") - F.col("trend")).over(Window.partitionBy(F.weekday("date"))))
    return total.withColumn("rest", F.col("sales") - F.col("trend") - F.col("seasonal"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and distinct values of each column, in one pass."""
    return df.agg(F.count("*").alias("n"), *(F.countDistinct(c).alias(f"n_{c}") for c in columns))


def missing_numbers(df: DataFrame, group: str, number: str) -> DataFrame:
    """Numbers between a group's least and greatest that it doesn't have."""
    own = df.select(group, F.col(number).alias("number")).distinct()
    span = own.groupBy(group).agg(F.min("number").alias("a"), F.max("number").alias("b"))
    return span.select(group, F.explode(F.sequence("a", "b")).alias("number")).join(own, [group, "number"], "left_anti")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def bottom_up(predictions: DataFrame, names: list[str]) -> DataFrame:
    """date, actual and a column of summed forecasts for each level. predictions: level, date, sales, y_pred."""
    own = predictions.groupBy("date").pivot("level", names).agg(F.sum("y_pred"))
    actual = predictions.where(F.col("level") == names[0]).groupBy("date").agg(F.sum("sales").alias("actual"))
    return actual.join(own, "date")


def total_metrics(wide: DataFrame, names: list[str], train_total: DataFrame) -> DataFrame:
    """level, wape and wrmsse of each bottom-up column against the actual total; the scale is that of the total series."""
    scale = naive_scales(train_total).agg(F.max("mse_scale").alias("scale"))
    long = wide.unpivot(["date", "actual"], names, "level", "y_pred")
    measures = point("actual", "y_pred")
    own = long.groupBy("level").agg(measures["wape"].alias("wape"), measures["rmse"].alias("rmse"))
    return own.join(F.broadcast(scale)).select("level", "wape", div("rmse", F.sqrt("scale")).alias("wrmsse"))


def averages_over_levels(results: DataFrame) -> DataFrame:
    """model, grain, tuned, mean wape and wrmsse, n_levels. A name that ends in (bench) is that model untuned."""
    tuned = ~F.col("model").rlike(r"\(bench\)\s*$")
    rows = results.withColumns({"tuned": tuned, "model": F.regexp_replace("model", r"\s*\(bench\)\s*$", "")})
    return rows.groupBy("model", "grain", "tuned").agg(F.avg("wape").alias("wape"), F.avg("wrmsse").alias("wrmsse"), F.countDistinct("level").alias("n_levels"))


def winners(results: DataFrame) -> DataFrame:
    """model, n: how many levels and grains it is best in."""
    best = results.groupBy("level", "grain").agg(F.min_by("model", F.struct("wrmsse", "model")).alias("model"))
    return best.groupBy("model").agg(F.count("*").alias("n"))


def importance_ranks(importances: DataFrame) -> DataFrame:
    """model, feature, importance, share of the model's total and rank, first by name where equal."""
    own = Window.partitionBy("model")
    return importances.withColumns({"share": share_of("importance", "model"), "rank": F.row_number().over(own.orderBy(F.desc("importance"), "feature"))})


def restock(report: DataFrame, margin: float = 1.15, shift_above: float = 6000.0) -> DataFrame:
    """Error in percent, what to order with a margin, and whether a shift is to be added."""
    return report.withColumns({"error_pct": 100 * div(F.col("y_pred") - F.col("sales"), F.col("sales")), "reorder": F.rint(F.col("y_pred") * margin), "extra_shift": F.col("y_pred") > shift_above})


def sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, the same each time and in any engine: the least by the MD5 of their key and the seed."""
    return df.orderBy(F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in key), F.lit(str(seed))).cast("binary")), *key).limit(n)
