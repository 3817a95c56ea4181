"""Errors of forecasts: point, scaled by a naive error, and inventory costs. All are grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.config import TWEEDIE_POWER
from tallyframe.functions import by_date, div

SERIES = "series_id"


def clip_closed(df: DataFrame, forecast: str = "forecast") -> DataFrame:
    """No forecast on days that the store is closed."""
    if "is_store_closed" not in df.columns:
        return df
    return df.withColumn(forecast, F.when(F.col("is_store_closed") == 1, F.lit(0.0)).otherwise(F.col(forecast)))


def point(y: str = "sales", f: str = "forecast") -> dict[str, Column]:
    """Aggregates by name: wape, bias, smape, mae, rmse, rmsle, tracking_signal."""
    y, f = F.col(y), F.col(f)
    gap = F.abs(y - f)
    log = F.log1p(F.greatest(f, F.lit(0.0))) - F.log1p(F.greatest(y, F.lit(0.0)))
    return {
        "wape": div(F.sum(gap), F.sum(F.abs(y))),
        "bias": div(F.sum(f - y), F.sum(F.abs(y))),
        "smape": F.avg(2 * gap / (F.abs(y) + F.abs(f) + 1e-8)),
        "mae": F.avg(gap),
        "rmse": F.sqrt(F.avg((y - f) * (y - f))),
        "rmsle": F.sqrt(F.avg(log * log)),
        "tracking_signal": F.coalesce(div(F.sum(y - f), F.avg(gap)), F.lit(0.0)),
    }


def objective(kind: str = "rmse", y: str = "sales", f: str = "forecast", power: float = TWEEDIE_POWER) -> Column:
    """The aggregate that decides between models: RMSE, or the mean Tweedie deviance."""
    if kind != "tweedie":
        return point(y, f)["rmse"]
    y, f = F.col(y), F.greatest(F.col(f), F.lit(1e-6))
    own = F.pow(F.greatest(y, F.lit(0.0)), 2 - power) / ((1 - power) * (2 - power))
    return F.avg(2 * (own - y * F.pow(f, 1 - power) / (1 - power) + F.pow(f, 2 - power) / (2 - power)))


def naive_scales(train: DataFrame, m: int = 1, target: str = "sales") -> DataFrame:
    """series_id, mse_scale, mae_scale: error of the m-step naive forecast in train, from a series' first sale on."""
    started = F.max((F.col("sales") != 0).cast("int")).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    rows = train.select(SERIES, "date", "sales", F.col(target).alias("__y")).withColumn("__on", started).where("__on = 1")
    step = F.col("__y") - F.lag("__y", m).over(by_date())
    return rows.withColumn("__e", step).groupBy(SERIES).agg(F.avg(F.col("__e") * F.col("__e")).alias("mse_scale"), F.avg(F.abs("__e")).alias("mae_scale")).where("mse_scale is not null")


def dollar_weights(train: DataFrame, days: int = 28) -> DataFrame:
    """series_id, weight: revenue of the last days of train; series without any are 0 where it is joined."""
    last = train.agg(F.max("date").alias("__last"))
    return train.join(F.broadcast(last)).where(F.col("date") > F.date_sub("__last", days)).groupBy(SERIES).agg(F.coalesce(F.sum(F.col("sales") * F.col("avg_sell_price")), F.lit(0.0)).alias("weight"))


def scaled_by_series(valid: DataFrame, scales: DataFrame, y: str = "sales", f: str = "forecast") -> DataFrame:
    """series_id, rmsse, mase; series without a scale, or with a zero one, are left out of that measure (null)."""
    gap = F.col(y) - F.col(f)
    own = valid.groupBy(SERIES).agg(F.avg(gap * gap).alias("__mse"), F.avg(F.abs(gap)).alias("__mae"))
    return own.join(scales, SERIES, "left").select(SERIES, F.sqrt(div("__mse", "mse_scale")).alias("rmsse"), div("__mae", "mae_scale").alias("mase"))


def weighted(per_series: DataFrame, weights: DataFrame | None, measures: dict[str, str]) -> DataFrame:
    """One row: each measure (name -> column) averaged by weight; the plain mean without weights or where they add up to 0."""
    if weights is None:
        return per_series.agg(*(F.avg(c).alias(n) for n, c in measures.items()))
    rows = per_series.join(weights, SERIES, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return rows.agg(*(F.coalesce(div(F.sum(F.col(c) * F.col("weight")), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))), F.avg(c)).alias(n) for n, c in measures.items()))


def spec_by_series(df: DataFrame, y: str = "sales", f: str = "forecast", under: float = 0.75, over: float = 0.25, *keys: str) -> DataFrame:
    """series_id, spec: cost of stock that lies about or lacks, by the units and days that demand and forecast are apart.

    A pair of days i <= t costs by cumulative sums. Each series is one row of arrays, short ones (a block or a year of days), and the
    pairs are folded there without a join.
    """
    keys = keys or (SERIES,)
    rows = Window.partitionBy(*keys).orderBy("date")
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    own = df.select(*keys, F.col(y).alias("__y"), F.col(f).alias("__f"), F.row_number().over(rows).alias("__i"), F.sum(y).over(upto).alias("__cy"), F.sum(f).over(upto).alias("__cf"))
    packed = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__y", "__f", "__cy", "__cf"))).alias("__a"))
    cost = f"greatest(0D, {under} * least(x.__y, x.__cy - z.__cf), {over} * least(x.__f, x.__cf - z.__cy)) * (z.__i - x.__i + 1)"
    total = F.expr(f"aggregate(__a, 0D, (s, x) -> s + aggregate(slice(__a, x.__i, size(__a)), 0D, (r, z) -> r + {cost}))")
    return packed.select(*keys, (total / F.size("__a")).alias("spec"))


def evaluate(train: DataFrame, valid: DataFrame, m: int = 1) -> DataFrame:
    """One row with the seven point metrics, wrmsse, wmase and wspec of valid (with forecast)."""
    valid = clip_closed(valid)
    weights = dollar_weights(train) if "avg_sell_price" in train.columns else None
    scaled = weighted(scaled_by_series(valid, naive_scales(train, m)).join(spec_by_series(valid), SERIES), weights, {"wrmsse": "rmsse", "mase": "mase", "spec": "spec"})
    overall = valid.agg(*(c.alias(n) for n, c in point().items()))
    return overall.join(F.broadcast(scaled))  # one row each


def predictions_report(valid: DataFrame) -> DataFrame:
    """Row by row: the forecast rounded half to even, its error, and what it would earn."""
    rows = clip_closed(valid).withColumn("y_pred", F.rint("forecast"))
    error = F.col("sales") - F.col("y_pred")
    return rows.select(SERIES, "date", "sales", "gross_sales", (F.col("y_pred") * F.col("avg_sell_price")).alias("gross_sales_pred"), "y_pred", error.alias("error"), F.abs(error).alias("abs_error"), div(F.abs(error), F.abs("sales")).alias("wape"), div(-error, F.abs("sales")).alias("bias"))


def series_metrics(train: DataFrame, report: DataFrame, m: int = 1, *keys: str) -> DataFrame:
    """15 measures for each series of a predictions report. Its wrmsse weighs a date's squared error by that date's revenue."""
    square = (F.col("sales") - F.col("y_pred")) * (F.col("sales") - F.col("y_pred"))
    measures = point("sales", "y_pred")
    own = report.groupBy(SERIES).agg(
        F.count("*").alias("n_days"), F.sum((F.col("sales") > 0).cast("int")).alias("n_days_with_sales"),
        *(F.sum(c).alias(c) for c in ("sales", "y_pred", "error", "abs_error", "gross_sales")),
        *(measures[k].alias(k) for k in ("wape", "bias", "rmsle", "tracking_signal")),
        F.avg(square).alias("__mse"), F.avg(F.abs(F.col("sales") - F.col("y_pred"))).alias("__mae"),
        div(F.sum(square * F.col("gross_sales")), F.sum("gross_sales")).alias("__wmse"),
    )
    total = own.agg(F.sum("gross_sales").alias("__all"))
    spec = spec_by_series(report, "sales", "y_pred")
    rows = own.join(naive_scales(train, m), SERIES, "left").join(spec, SERIES).join(F.broadcast(total))
    return rows.select(
        SERIES, "n_days", "n_days_with_sales", "sales", "y_pred", "error", "abs_error", "gross_sales", div("gross_sales", "__all").alias("gross_sales_pct"),
        "wape", "bias", "rmsle", "tracking_signal", F.sqrt(div(F.coalesce("__wmse", "__mse"), "mse_scale")).alias("wrmsse"), div("__mae", "mae_scale").alias("mase"), "spec",
    )
