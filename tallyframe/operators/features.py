"""Panel features. Each function adds columns to a panel (series_id, date, ...) and keeps its rows.

Windows count rows, not days; a panel is made dense before them. Every window's partition starts with series_id, so after one
exchange the features only sort.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.config import CLOSING_EVENTS, CLOSURE_DAYS, ENCODING_ROWS, EVENT_TYPES, LAGS, PRIOR_ROWS, STOCKOUT_DAYS, TRACKED_EVENTS, TRANSFORMS
from tallyframe.functions import by_date, days_since_last, days_to_next, div, floor_zero, up_to_today, up_to_yesterday


# calendar ---------------------------------------------------------------------------------------------------------------------
def calendar_features(df: DataFrame) -> DataFrame:
    """Quarter, first and last day of a month, and the place in week, month-of-year and year on a circle."""
    date = F.col("date")

    def circle(name: str, step: Column, period: float) -> dict[str, Column]:
        angle = F.lit(2 * math.pi) * (step - 1) / F.lit(period)
        return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}

    return df.withColumns({
        "quarter": F.quarter(date), "is_month_start": (F.dayofmonth(date) == 1).cast("int"), "is_month_end": (date == F.last_day(date)).cast("int"),
        **circle("dow", F.weekday(date) + 1, 7.0), **circle("month", F.month(date), 12.0), **circle("doy", F.dayofyear(date), 365.25),
    })


# prices -----------------------------------------------------------------------------------------------------------------------
def price_features(df: DataFrame) -> DataFrame:
    """The price against its highest so far, its deviation over 90 rows, and the days since it last changed."""
    price, rows = F.col("avg_sell_price"), by_date()
    df = df.withColumns({"__max": F.max(price).over(up_to_today(rows)), "price_volatility": F.stddev_samp(price).over(rows.rowsBetween(-89, 0)), "__moved": F.coalesce(price != F.lag(price).over(rows), F.lit(False))})
    return df.withColumns({"price_vs_max": F.when(price.isNotNull(), div(price, "__max")), "days_since_price_change": days_since_last(F.col("__moved"))}).drop("__max", "__moved")


# events -----------------------------------------------------------------------------------------------------------------------
def _is_event(*names: str) -> Column:
    return F.coalesce(F.col("event_name_1").isin(*names), F.lit(False)) | F.coalesce(F.col("event_name_2").isin(*names), F.lit(False))


def event_type_code(column: str) -> Column:
    out = F.lit(0)
    for name, code in EVENT_TYPES.items():
        out = F.when(F.col(column) == name, F.lit(code)).otherwise(out)
    return out


def event_distance(df: DataFrame, names: tuple[str, ...] = TRACKED_EVENTS) -> DataFrame:
    """days_since_<event> and days_to_<event> for each name."""
    return df.withColumns({f"days_{way}_{n.lower()}": f(_is_event(n)) for n in names for way, f in (("since", days_since_last), ("to", days_to_next))})


def signed_closure(df: DataFrame) -> DataFrame:
    """is_store_closed by the calendar, and days_to_closure: positive before the nearest closure, negative after, null beyond a week."""
    closed = _is_event(*CLOSING_EVENTS)
    df = df.withColumns({"is_store_closed": closed.cast("int"), "__s": days_since_last(closed), "__n": days_to_next(closed)})
    since, ahead = F.col("__s"), F.col("__n")
    nearest = F.when(ahead.isNull(), -since).when(since.isNull() | (ahead <= since), ahead).otherwise(-since)
    return df.withColumn("days_to_closure", F.when(F.abs(nearest) <= CLOSURE_DAYS, nearest)).drop("__s", "__n")


def days_since_release(df: DataFrame) -> DataFrame:
    """Days since the first row with a price; null before it."""
    released = F.min(F.when(F.col("avg_sell_price").isNotNull(), F.col("date"))).over(Window.partitionBy("series_id"))
    age = F.datediff("date", released)
    return df.withColumn("__age", age).withColumn("days_since_release", F.when(F.col("__age") >= 0, F.col("__age"))).drop("__age")


def zero_when_closed(df: DataFrame) -> DataFrame:
    """No sales on days that a closing event is on. Runs before encoding, intermittency and lags."""
    shut = F.col("is_store_closed") == 1
    return df.withColumns({c: F.when(shut, F.lit(0.0)).otherwise(F.col(c)) for c in ("sales", "gross_sales")})


def event_features(df: DataFrame) -> DataFrame:
    some = (F.col("has_event") == 1) | (F.col("has_event_2") == 1)
    df = days_since_release(df)
    df = df.withColumns({"days_since_event": days_since_last(some), "days_to_event": days_to_next(some), "event_type_1_enc": event_type_code("event_type_1"), "event_type_2_enc": event_type_code("event_type_2")})
    return zero_when_closed(signed_closure(event_distance(df)))


# encoding ---------------------------------------------------------------------------------------------------------------------
def rolling_encoding(df: DataFrame, dim: str, rows: int = ENCODING_ROWS) -> DataFrame:
    """te_<dim>_mean, _std and _n: the mean sale of a series of the same dim, over the previous rows of that dim.

    The aggregate is by dim and date, which partial aggregation makes small; it is joined back on the same keys.
    """
    key = dim.removesuffix("_id")
    before = Window.partitionBy(dim).orderBy("date").rowsBetween(-rows, -1)
    daily = df.groupBy(dim, "date").agg(F.avg("sales").alias("__daily"))
    stats = daily.select(dim, "date", F.avg("__daily").over(before).alias(f"te_{key}_mean"), F.stddev_samp("__daily").over(before).alias(f"te_{key}_std"), F.count("__daily").over(before).alias(f"te_{key}_n"))
    return df.join(stats, [dim, "date"], "left")


def shrink(child: str, n: str, parent: str, weight: int = PRIOR_ROWS) -> Column:
    """child's mean with n rows, drawn towards parent's mean as if that were ``weight`` rows more."""
    return (F.col(n) * F.col(child) + F.lit(weight) * F.col(parent)) / (F.col(n) + F.lit(weight))


def shrunk(df: DataFrame) -> DataFrame:
    """Departments are drawn to their category, then items to the corrected department."""
    df = df.withColumn("te_dept_mean", shrink("te_dept_mean", "te_dept_n", "te_cat_mean"))
    return df.withColumn("te_item_mean", shrink("te_item_mean", "te_item_n", "te_dept_mean"))


def conditional_mean(flag: str) -> Column:
    """The series' mean sale over earlier rows with the same flag."""
    return F.avg("sales").over(up_to_yesterday(by_date(flag)))


def encoding_features(df: DataFrame) -> DataFrame:
    for dim in ("item_id", "dept_id", "cat_id"):
        df = rolling_encoding(df, dim)
    df = shrunk(df).drop("te_item_n", "te_dept_n", "te_cat_n")
    return df.withColumns({"te_weekend_mean": conditional_mean("is_weekend"), "te_snap_mean": conditional_mean("snap"), "te_event_mean": conditional_mean("has_event")})


# intermittency ----------------------------------------------------------------------------------------------------------------
def zero_streak() -> Column:
    """Days without a sale up to yesterday, in days also where rows are weeks; null before the first sale."""
    sold = F.last(F.when(F.col("sales") > 0, F.col("date")), ignorenulls=True).over(up_to_yesterday(by_date()))
    return floor_zero(F.datediff("date", sold) - 1)


def share_of_zeros(rows: int) -> Column:
    return F.avg((F.col("sales") == 0).cast("double")).over(by_date().rowsBetween(-rows, -1))


def adi_expanding() -> Column:
    """Average days between sales: days since release up to yesterday by days with a sale up to yesterday."""
    sold = F.sum((F.col("sales") > 0).cast("int")).over(up_to_yesterday(by_date()))
    return div(floor_zero(F.col("days_since_release") - 1), sold)


def cv2(rows: int = 90) -> Column:
    """Squared coefficient of variation of the previous rows, two at least."""
    before = by_date().rowsBetween(-rows, -1)
    ratio = div(F.stddev_samp("sales").over(before), F.avg("sales").over(before))
    return F.when(F.count("sales").over(before) >= 2, ratio * ratio)


def intermittency_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({"zero_streak": zero_streak(), "pct_zero_28": share_of_zeros(28), "pct_zero_90": share_of_zeros(90), "adi_expanding": adi_expanding(), "cv2_90": cv2(90)})
    short = F.col("avg_sell_price").isNotNull() & (F.col("zero_streak") >= STOCKOUT_DAYS) & (F.col("is_store_closed") != 1)
    return df.withColumn("is_likely_stockout", F.coalesce(short, F.lit(False)).cast("int"))


# lags -------------------------------------------------------------------------------------------------------------------------
STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lag_features(df: DataFrame, grain: str, target: str = "sales", only: str | None = None) -> DataFrame:
    """The lag families of a grain: 131 daily columns or 49 weekly ones; only: a pattern that names are to match.

    A statistic over w rows that end k rows ago is the statistic over the last w rows, k rows ago. So each width is computed once, and
    the sliding frames, whose cost grows with their width, stay as few as the widths.
    """
    rows = by_date()
    wanted = re.compile(only or "")
    out: dict[str, Column] = {f"lag{k}": F.lag(target, k).over(rows) for k in LAGS[grain]}
    widths: set[tuple[str, int]] = set()

    def rolled(stat: str, width: int, lag: int) -> Column:
        widths.add((stat, width))
        return F.lag(f"__{stat}_{width}", lag).over(rows)

    late: dict[str, Column] = {}
    for lag, kinds in TRANSFORMS[grain].items():
        for width in kinds.get("rolling", ()):
            for stat in STATISTICS:
                name = f"rolling_{stat}_lag{lag}_window_size{width}"
                if wanted.search(name):
                    late[name] = rolled(stat, width, lag)
        if "momentum" in kinds:
            short, long = kinds["momentum"]
            if wanted.search(name := f"momentum_lag{lag}_{short}_{long}"):
                late[name] = div(rolled("mean", short, lag), rolled("mean", long, lag))
        if kinds.get("expanding") and wanted.search(name := f"expanding_mean_lag{lag}"):
            late[name] = F.avg(target).over(rows.rowsBetween(Window.unboundedPreceding, -lag))
        for season, count in kinds.get("seasonal", ()):
            if wanted.search(name := f"seasonal_mean_lag{lag}_{season}_{count}"):
                late[name] = sum((F.lag(target, lag + j * season).over(rows) for j in range(1, count)), F.lag(target, lag).over(rows)) / count
    frames = {f"__{stat}_{w}": F.when(F.count(target).over(rows.rowsBetween(1 - w, 0)) == w, STATISTICS[stat](target).over(rows.rowsBetween(1 - w, 0))) for stat, w in sorted(widths)}
    return df.withColumns(frames).withColumns({k: v for k, v in (out | late).items() if wanted.search(k)}).drop(*frames) if frames else df.withColumns({k: v for k, v in (out | late).items() if wanted.search(k)})


def lag_names(grain: str) -> list[str]:
    """Every lag family column of a grain, in a fixed order."""
    names = [f"lag{k}" for k in LAGS[grain]]
    for lag, kinds in TRANSFORMS[grain].items():
        names += [f"rolling_{stat}_lag{lag}_window_size{w}" for w in kinds.get("rolling", ()) for stat in STATISTICS]
        if "momentum" in kinds:
            names.append("momentum_lag{}_{}_{}".format(lag, *kinds["momentum"]))
        names += [f"expanding_mean_lag{lag}"] if kinds.get("expanding") else []
        names += [f"seasonal_mean_lag{lag}_{s}_{c}" for s, c in kinds.get("seasonal", ())]
    return names


# all --------------------------------------------------------------------------------------------------------------------------
def derived_features(df: DataFrame) -> DataFrame:
    """Calendar, price, event, encoding and intermittency features, in the order that the zeroed closures need."""
    return intermittency_features(encoding_features(event_features(price_features(calendar_features(df)))))


def featured(df: DataFrame, grain: str) -> DataFrame:
    """A panel with all its features: 195 daily or 113 weekly columns. Cast to float at the sink, not before."""
    return lag_features(derived_features(df), grain)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats, for a sink."""
    return df.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
