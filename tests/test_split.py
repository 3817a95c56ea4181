"""Splits, blocks and masks."""

import datetime as dt

from tallyframe.operators import split

REF = dt.date(2016, 1, 1)


def days(spark, n, extra=""):
    return spark.createDataFrame([("S", REF + dt.timedelta(days=i), float(i), float(i)) for i in range(n)], "series_id string, date date, lag7 double, sales double")


def test_block_origins(spark):
    out = days(spark, 364).withColumn("o", split.block_origin(REF, "daily")).orderBy("date").collect()
    assert {r.o for r in out[:28]} == {REF - dt.timedelta(days=1)}
    assert out[28].o == REF + dt.timedelta(days=27)
    assert len({r.o for r in out}) == 13
    assert len(split.valid_blocks(REF, REF + dt.timedelta(days=364), "daily")) == 13
    assert split.valid_blocks(REF, REF + dt.timedelta(days=30), "daily")[-1] == (1, REF + dt.timedelta(days=28), REF + dt.timedelta(days=30))


def test_folds_and_masks(spark):
    s = split.date_split(days(spark, 228), 28, 28)
    assert s.days == (172, 28, 28)
    folds = split.rolling_folds(days(spark, 228), s, "daily", 3)
    assert len(folds) == 3
    for train, valid in folds:
        rows = valid.orderBy("date").collect()
        assert len(rows) == 28
        assert [r.lag7 is not None for r in rows] == [True] * 7 + [False] * 21  # never a lag below the horizon
        assert train.agg({"date": "max"}).first()[0] < rows[0].date
        assert train.where("lag7 is null").count() == 0


def test_anchor():
    assert split.anchor("rolling_mean_lag28_window_size7") == 28
    assert split.anchor("momentum_lag1_7_35") == 1
    assert split.anchor("te_item_mean") is None


def test_tail_and_fixed_start(spark):
    s = split.date_split(days(spark, 100), 20, 10, tail_reserve_days=5)
    assert s.last == REF + dt.timedelta(days=94) and s.test_start == REF + dt.timedelta(days=85)
    assert split.date_split(days(spark, 100), 20, 10, test_start=REF + dt.timedelta(days=50)).valid_start == REF + dt.timedelta(days=30)
