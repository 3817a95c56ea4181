"""The fact is dealt to portions in proportion to its lines, so that a task's rows don't grow with the input."""

import duckdb
import pytest

from tallyframe.config import BY_NAME
from tallyframe.plans import panel
from tallyframe.queries import ORACLES, QUERIES
from tallyframe.sources import star
from test_queries import SMALL, TABLES, _plain

LINES = 6_000


def twin(name, got, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, key = con.sql(ORACLES[name]).df(), lambda r: tuple(map(str, r))
    assert sorted(map(tuple, _plain(got.toPandas())), key=key) == sorted(map(tuple, _plain(want)), key=key)


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Broadcast" not in x]


@pytest.fixture
def small_portions(monkeypatch):
    """As 3 million lines would be dealt."""
    monkeypatch.setattr(star, "PORTION", 500)


@pytest.mark.parametrize("grain", ["daily", "weekly"])
@pytest.mark.parametrize("level", ["item_store", "item_state", "store_dept", "state_dept", "item", "store", "dept", "state_cat", "state"])
def test_panel_tasks_grow_with_lines(spark, small_portions, level, grain):
    df = panel.panel(spark, SMALL, level, grain)
    assert not [x for x in exchanges(df) if "ENSURE_REQUIREMENTS" in x]  # these may be made fewer and larger
    if level == "item_store":
        assert df.rdd.getNumPartitions() == LINES // 500
        assert max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 2 * 500


@pytest.mark.parametrize("name", ["panel_item_store_daily", "panel_state_dept_weekly", "panel_total_daily", "level_sets", "count_series", "size_estimate", "sink_split", "sbc_class"])
def test_many_portions_same_rows(spark, small_portions, name):
    twin(name, QUERIES[name](spark, SMALL))


def test_levels_tasks_grow_with_lines(spark, small_portions):
    df = panel.all_levels(spark, SMALL, "weekly")
    assert not [x for x in exchanges(df) if "ENSURE_REQUIREMENTS" in x]
    assert df.rdd.getNumPartitions() == 12 * 2 * LINES // 500 // 8
    assert max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 3 * 4 * 500


def test_series_tasks_grow_with_lines(spark, small_portions):
    df = panel.series(spark, SMALL)
    assert not [x for x in exchanges(df) if "ENSURE_REQUIREMENTS" in x]
    assert df.rdd.getNumPartitions() == 12 * LINES // 500 // 4


def test_no_lines_have_no_series(spark, tmp_path):
    for t in TABLES:
        rows = star.read(spark, SMALL, t)
        (rows.limit(0) if t == "lineitem" else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    assert {r.n for r in QUERIES["count_series"](spark, str(tmp_path)).collect()} == {0}
    assert panel.panel(spark, str(tmp_path), "dept", "weekly").count() == 0
    assert QUERIES["level_sets"](spark, str(tmp_path)).count() == 0


def test_item_of_most_lines_is_many_tasks(spark, small_portions, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '{SMALL}/{t}.parquet'"
        if t == "lineitem":
            rows = f"SELECT * REPLACE (CASE WHEN l_linenumber <> 2 THEN (SELECT MIN(p_partkey) FROM '{SMALL}/part.parquet') ELSE l_partkey END AS l_partkey, l_orderkey % (SELECT COUNT(*) FROM '{SMALL}/supplier.parquet') + (SELECT MIN(s_suppkey) FROM '{SMALL}/supplier.parquet') AS l_suppkey) FROM '{SMALL}/lineitem.parquet'"
        con.sql(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
    dealt = star.sales_by_slot(spark, str(tmp_path)).groupBy("slot").count().toPandas()["count"]
    assert dealt.max() < dealt.sum() / 3
    twin("panel_item_weekly", QUERIES["panel_item_weekly"](spark, str(tmp_path)), tmp_path)


def test_many_stores_are_dealt(spark, small_portions, monkeypatch):
    monkeypatch.setattr(star, "FEW_STORES", 0)
    df = panel.aggregate(star.joined(spark, SMALL), BY_NAME["store_cat"], "daily")
    assert not [x for x in exchanges(df) if "ENSURE_REQUIREMENTS" in x]
    twin("panel_store_cat_daily", QUERIES["panel_store_cat_daily"](spark, SMALL))
