"""Queries that take every day."""

import duckdb

from tallyframe.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_unpivot_all_days(spark):
    con = duckdb.connect()
    for t in "region nation supplier part lineitem".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = {(a, b): round(float(c), 2) for a, b, c in con.sql(ORACLES["unpivot_all_days"]).fetchall()}
    got = {(r.cat_id, r.d): round(float(r.sales), 2) for r in QUERIES["unpivot_all_days"](spark, SMALL).collect()}
    assert got == want and len({d for _, d in got}) > 28
