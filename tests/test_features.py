"""Features against values by hand."""

import datetime as dt
import math

import pytest

from tallyframe.config import EXOGENOUS
from tallyframe.operators import features as f

DAY = dt.date(2024, 1, 1)



def values(df, column, order=("series_id", "date")):
    return [r[0] for r in df.orderBy(*order).select(column).collect()]


def near(got, want, digits=6):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None) == (b is None), (got, want)
        if a is not None:
            assert a == pytest.approx(b, abs=10**-digits), (got, want)


def test_calendar(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 31), dt.date(2024, 4, 1), dt.date(2024, 1, 4)]
    out = {r.date: r for r in f.calendar_features(spark.createDataFrame([(d,) for d in days], "date date")).collect()}
    first = out[days[0]]
    assert (first.quarter, first.is_month_start) == (1, 1)
    assert [first.dow_sin, first.month_sin, first.doy_sin] == [0, 0, 0] and [first.dow_cos, first.month_cos, first.doy_cos] == [1, 1, 1]
    assert out[days[1]].is_month_end == 1
    assert out[days[2]].quarter == 2 and out[days[2]].month_sin == pytest.approx(1)
    assert out[days[3]].dow_sin == pytest.approx(math.sin(2 * math.pi * 3 / 7))


def priced(spark, *series):
    rows = [(f"S{k}", DAY + dt.timedelta(days=i), float(p)) for k, prices in enumerate(series) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "series_id string, date date, avg_sell_price double")


def test_prices(spark):
    near(values(f.price_features(priced(spark, [10, 20, 15, 20, 5])), "price_vs_max"), [1, 1, 0.75, 1, 0.25])
    near(values(f.price_features(priced(spark, [10, 20, 10, 20, 30])), "price_volatility")[:3], [None, math.sqrt(50), math.sqrt(100 / 3)])
    near(values(f.price_features(priced(spark, [10, 10, 20, 20, 20])), "days_since_price_change"), [None, None, 0, 1, 2])
    near(values(f.price_features(priced(spark, [10, 5], [100, 100])), "price_vs_max"), [1, 0.5, 1, 1])


def test_events(spark):
    names = [None, "Thanksgiving", None, "Christmas", None, None]
    sales, gross = [10, 6, 10, 999, 10, 10], [100, 60, 100, 9999, 100, 100]
    rows = [("S", DAY + dt.timedelta(days=i), 10.0, int(n is not None), 0, n, "National" if n else None, None, None, float(s), float(g)) for i, (n, s, g) in enumerate(zip(names, sales, gross))]
    schema = "series_id string, date date, avg_sell_price double, has_event int, has_event_2 int, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, sales double, gross_sales double"
    out = f.event_features(spark.createDataFrame(rows, schema))
    near(values(out, "is_store_closed"), [0, 0, 0, 1, 0, 0])
    near(values(out, "sales"), [10, 6, 10, 0, 10, 10])
    near(values(out, "gross_sales"), [100, 60, 100, 0, 100, 100])
    near(values(out, "days_since_event"), [None, 0, 1, 0, 1, 2])
    near(values(out, "days_to_event"), [1, 0, 1, 0, None, None])
    near(values(out, "days_to_closure"), [3, 2, 1, 0, -1, -2])
    near(values(out, "event_type_1_enc"), [0, 3, 0, 3, 0, 0])
    near(values(out, "days_since_thanksgiving"), [None, 0, 1, 2, 3, 4])
    near(values(out, "days_to_thanksgiving"), [1, 0, None, None, None, None])
    near(values(out, "days_since_release"), [0, 1, 2, 3, 4, 5])


def intermittent(spark, closed=()):
    sales = [5, 0, 0, 0, 0, 0, 0, 0, 10, 0]
    rows = [("S", DAY + dt.timedelta(days=i), float(s), 10.0, int(i in closed), i) for i, s in enumerate(sales)]
    return f.intermittency_features(spark.createDataFrame(rows, "series_id string, date date, sales double, avg_sell_price double, is_store_closed int, days_since_release int"))


def test_intermittency(spark):
    out = intermittent(spark)
    near(values(out, "zero_streak"), [None, 0, 1, 2, 3, 4, 5, 6, 7, 0])
    adi = values(out, "adi_expanding")
    assert adi[0] is None and (adi[2], adi[7], adi[9]) == (1, 6, 4)
    near(values(out, "is_likely_stockout"), [0] * 8 + [1, 0])
    near(values(intermittent(spark, {8}), "is_likely_stockout"), [0] * 10)


def test_encoding(spark):
    rows = [(s, item, "D", "C", DAY + dt.timedelta(days=i), float(y), int(i == 3), 0, 0) for s, item, ys in (("S1", "I1", [10, 20, 30, 40, 50]), ("S2", "I2", [0] * 5)) for i, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "series_id string, item_id string, dept_id string, cat_id string, date date, sales double, is_weekend int, snap int, has_event int")
    out = f.encoding_features(df).orderBy("series_id", "date").collect()
    one, two = [r.te_item_mean for r in out[:5]], [r.te_item_mean for r in out[5:]]
    assert one[0] is None and two[0] is None
    assert one[2] == pytest.approx(8.75) and one[4] == pytest.approx(225 / 14)
    assert two[1] == pytest.approx(50 / 11) and two[2] == pytest.approx(6.25) and two[4] == pytest.approx(125 / 14)
    weekend = [r.te_weekend_mean for r in out[:5]]
    assert weekend[0] is None and weekend[3] is None and weekend[2] == pytest.approx(15) and weekend[4] == pytest.approx(20)


def test_lags(spark):
    rows = [("S", DAY + dt.timedelta(days=i), float(i)) for i in range(40)]
    out = f.lag_features(spark.createDataFrame(rows, "series_id string, date date, sales double"), "daily").orderBy("date").collect()
    assert [r.lag1 for r in out] == [None, *map(float, range(39))]
    assert [r.lag7 for r in out][:8] == [None] * 7 + [0.0]
    assert out[8].rolling_mean_lag2_window_size7 == pytest.approx(sum(range(0, 7)) / 7) and out[7].rolling_mean_lag2_window_size7 is None
    assert out[35].momentum_lag1_7_35 == pytest.approx(31 / 17)
    assert len(f.lag_names("daily")) == 131 and len(f.lag_names("weekly")) == 49
    assert set(f.lag_names("daily")) <= set(out[0].asDict())


@pytest.mark.parametrize("grain, columns", [("daily", 195), ("weekly", 113)])
def test_contract(spark, grain, columns):
    from tallyframe.plans.panel import EVENTS, with_exogenous

    step = 1 if grain == "daily" else 7
    rows = [(f"S{k}", f"I{k}", "D", "C", "T", "X", DAY + dt.timedelta(days=i * step), float(i % 5), float(i % 5 * p), p if i % 5 else None, *[None] * 4, 0) for k, p in ((1, 10.0), (2, 20.0)) for i in range(40)]
    schema = "series_id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, date date, sales double, gross_sales double, avg_sell_price double, " + ", ".join(f"{e} string" for e in EVENTS) + ", snap int"
    out = f.featured(with_exogenous(spark.createDataFrame(rows, schema), grain), grain)
    assert len(out.columns) == columns and set(EXOGENOUS) <= set(out.columns)
    assert out.count() == 80 and out.select("series_id", "date").distinct().count() == 80
    first, second = (out.orderBy("series_id", "date").limit(5).collect() for _ in range(2))
    assert first == second
