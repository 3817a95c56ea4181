"""Queries against their SQL twins on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tallyframe.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = ["panel_cat_daily", "panel_state_dept_weekly", "level_sets", "dataset_raw", "unpivot", "event_pre_post", "sbc_class", "signed_closure", "bayes_shrink", "stockout_flag", "lags_weekly", "mask_horizon", "seasonal_naive", "evaluate_predictions", "series_metrics", "total_metrics"]


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = lambda r: tuple(map(str, r))
    off = [(a, b) for a, b in zip(sorted(map(tuple, _plain(got)), key=key), sorted(map(tuple, _plain(want)), key=key)) if a != b]
    assert not off, off[:3]


def _plain(frame):
    for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        yield [None if v is None or v is pd.NA or v != v else str(v)[:10] if hasattr(v, "year") else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
