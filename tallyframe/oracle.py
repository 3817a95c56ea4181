"""SQL twins: common table expressions for DuckDB that build the same panels as the plans."""

from __future__ import annotations

from tallyframe.config import BY_NAME, CLOSING_EVENTS, DIMS, PRICE_LAG, TOTAL
from tallyframe.sources.star import EVENTS, SECOND, SNAP, WEEK_ONE

NAMES = ("event_name_1", "event_type_1", "event_name_2", "event_type_2")
W = "PARTITION BY series_id ORDER BY date"


def r(expression: str, digits: int = 4, name: str | None = None) -> str:
    """Rounded as queries.rounded does: a little is added first, so that exact halves go the same way in either engine."""
    return f"ROUND({expression} + 3e-{digits + 4:02d}, {digits}) + 0.0 AS {name or expression.split('.')[-1]}"


def i(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS INTEGER) AS {name or expression}"


def b(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _falls(event: tuple) -> str:
    _, _, month, first, last, weekday = event
    on = f"month(date) = {month} AND day(date) BETWEEN {first} AND {last}"
    return on if weekday is None else f"{on} AND isodow(date) = {weekday + 1}"


def _named(field: int) -> str:
    return "CASE " + " ".join(f"WHEN {_falls(e)} THEN {_q(e[field])}" for e in EVENTS) + " END"


_SNAPS = ", ".join(f"CASE WHEN day(date) BETWEEN {a} AND {z} THEN 1 ELSE 0 END AS snap_{s.replace(' ', '_')}" for s, (a, z) in SNAP.items())
SNAP_OF = "CASE state_id " + " ".join(f"WHEN '{s}' THEN snap_{s.replace(' ', '_')}" for s in SNAP) + " END"

STAR = f"""fact AS (
    SELECT CAST(l_partkey AS VARCHAR) AS item_id, p_type || '_' || p_brand AS dept_id, p_type AS cat_id, CAST(l_suppkey AS VARCHAR) AS store_id, r_name AS state_id,
           CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS sales, SUM(l_extendedprice) AS paid
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ALL),
days AS (SELECT CAST(UNNEST(generate_series(CAST(MIN(l_shipdate) AS DATE), CAST(MAX(l_shipdate) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date FROM lineitem),
named AS (SELECT date, {_named(0)} AS n1, {_named(1)} AS t1, ({_falls(SECOND)}) AS second FROM days),
cal AS (
    SELECT date, CAST((date - DATE '{WEEK_ONE}') // 7 + 1 AS INTEGER) AS wm_yr_wk, dayname(date) AS weekday, CAST(isodow(date) AS INTEGER) AS wday, CAST(month(date) AS INTEGER) AS month,
           CAST(year(date) AS INTEGER) AS year, 'd_' || (date - DATE '{WEEK_ONE}' + 1) AS d,
           COALESCE(n1, CASE WHEN second THEN '{SECOND[0]}' END) AS event_name_1, COALESCE(t1, CASE WHEN second THEN '{SECOND[1]}' END) AS event_type_1,
           CASE WHEN second AND n1 IS NOT NULL THEN '{SECOND[0]}' END AS event_name_2, CASE WHEN second AND n1 IS NOT NULL THEN '{SECOND[1]}' END AS event_type_2, {_SNAPS}
    FROM named),
price AS (SELECT store_id, item_id, CAST((date - DATE '{WEEK_ONE}') // 7 + 1 AS INTEGER) AS wm_yr_wk, SUM(paid) / NULLIF(SUM(sales), 0) AS sell_price FROM fact GROUP BY ALL),
joined AS (SELECT f.*, c.* EXCLUDE (date), p.sell_price FROM fact f LEFT JOIN cal c ON f.date = c.date LEFT JOIN price p ON f.store_id = p.store_id AND f.item_id = p.item_id AND c.wm_yr_wk = p.wm_yr_wk)"""

DATASET = f"""dataset AS (SELECT item_id || '_' || store_id AS series_id, state_id, store_id, cat_id, dept_id, item_id, date, sell_price, sales, COALESCE(sales, 0) * sell_price AS mnt_gross_sales,
    {SNAP_OF} AS snap, COALESCE(event_name_1, event_name_2) AS event_name, COALESCE(event_type_1, event_type_2) AS event_type FROM joined)"""


def _keys(dims: tuple[str, ...]) -> str:
    key = "concat_ws('_', " + ", ".join(dims) + ")" if dims else f"'{TOTAL}'"
    return f"{key} AS series_id, " + ", ".join(d if d in dims else f"'{TOTAL}' AS {d}" for d in DIMS)


def sparse(level: str, grain: str, where: str = "") -> str:
    dims = BY_NAME[level].dims
    time = "CAST(date_trunc('week', date) AS DATE)" if grain == "weekly" else "date"
    snap = f"MAX({SNAP_OF})" if "state_id" in dims else "0"
    return f"""base AS (SELECT {_keys(dims)}, first, {', '.join(NAMES)}, snap, sales, gross_sales, avg_sell_price FROM (
        SELECT {''.join(d + ', ' for d in dims)}{time} AS t, MIN(date) AS first, {', '.join(f'MAX({c}) AS {c}' for c in NAMES)}, {snap} AS snap, SUM(sales) AS sales, SUM(sales * sell_price) AS gross_sales,
               SUM(sales * sell_price) / NULLIF(SUM(sales), 0) AS avg_sell_price FROM joined {where} GROUP BY {''.join(d + ', ' for d in dims)}{time}))"""


def dense(level: str, grain: str) -> str:
    dims = BY_NAME[level].dims
    time = "CAST(date_trunc('week', date) AS DATE)" if grain == "weekly" else "date"
    listed = ", ".join(dims)
    snaps = [f"snap_{s.replace(' ', '_')}" for s in SNAP]
    snap = SNAP_OF if "state_id" in dims else "0"
    series = f"SELECT DISTINCT {listed} FROM joined" if dims else "SELECT 1 AS one"
    on = " AND ".join([f"g.{d} = a.{d}" for d in dims] + ["g.t = a.t"])
    return f"""periods AS (SELECT {time} AS t, MIN(date) AS first, {', '.join(f'MAX({c}) AS {c}' for c in (*NAMES, *snaps))} FROM cal GROUP BY 1),
sums AS (SELECT {listed + ', ' if dims else ''}{time} AS t, SUM(sales) AS sales, SUM(sales * sell_price) AS gross_sales, SUM(sales * sell_price) / NULLIF(SUM(sales), 0) AS avg_sell_price FROM joined GROUP BY ALL),
grid AS (SELECT * FROM ({series}) CROSS JOIN periods),
base AS (SELECT {_keys(tuple()) if not dims else ', '.join([f"concat_ws('_', {', '.join('g.' + d for d in dims)}) AS series_id"] + [f'g.{d}' if d in dims else f"'{TOTAL}' AS {d}" for d in DIMS])},
    first, {', '.join(NAMES)}, {snap.replace('state_id', 'g.state_id')} AS snap, COALESCE(sales, 0) AS sales, COALESCE(gross_sales, 0) AS gross_sales, avg_sell_price
    FROM grid g LEFT JOIN sums a ON {on})"""


def exogenous(grain: str) -> str:
    n = PRICE_LAG[grain]
    return f"""rows AS (SELECT * RENAME (first AS date) FROM base),
exog AS (SELECT *, LAG(avg_sell_price, {n}) OVER ({W}) AS price_lag_{n}, AVG(avg_sell_price) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM rows),
p AS (SELECT series_id, {', '.join(DIMS)}, date, sales, gross_sales, avg_sell_price, price_lag_{n}, avg_sell_price / NULLIF(price_lag_{n}, 0) - 1 AS price_change, avg_sell_price / NULLIF(mean, 0) AS price_vs_mean,
    CASE WHEN event_name_1 IS NULL THEN 0 ELSE 1 END AS has_event, CASE WHEN event_name_2 IS NULL THEN 0 ELSE 1 END AS has_event_2, snap, {', '.join(NAMES)},
    year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) AS dayofweek, weekofyear(date) AS weekofyear, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM exog)"""


def panel_select(grain: str) -> str:
    n = PRICE_LAG[grain]
    return f"""SELECT series_id, {', '.join(DIMS)}, date, {r('sales', 2)}, {r('gross_sales', 2)}, {r('avg_sell_price')}, {r(f'price_lag_{n}')}, {r('price_change')}, {r('price_vs_mean')},
    {i('has_event')}, {i('has_event_2')}, {i('snap')}, {', '.join(NAMES)}, {', '.join(i(c) for c in ('year', 'month', 'day', 'dayofweek', 'weekofyear', 'is_weekend'))} FROM p"""


def panel_sql(level: str, grain: str, where: str = "") -> str:
    return f"WITH {STAR}, {sparse(level, grain, where)}, {exogenous(grain)} {panel_select(grain)}"


def on_dense(level: str, grain: str, ctes: str, select: str) -> str:
    """A query over p, the dense panel, with more tables between."""
    return f"WITH {STAR}, {dense(level, grain)}, {exogenous(grain)}{', ' + ctes if ctes else ''} {select}"


_CLOSED = " OR ".join(f"COALESCE(event_name_1 = '{n}', FALSE) OR COALESCE(event_name_2 = '{n}', FALSE)" for n in CLOSING_EVENTS)
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
DOWN = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def since(flag: str) -> str:
    return f"date - LAST_VALUE(CASE WHEN {flag} THEN date END IGNORE NULLS) OVER ({W} {UP})"


def ahead(flag: str) -> str:
    return f"FIRST_VALUE(CASE WHEN {flag} THEN date END IGNORE NULLS) OVER ({W} {DOWN}) - date"


#: The panel with closures zeroed and days since release, as encoding, intermittency and lags see it.
EVENTED = f"""closing AS (SELECT *, ({_CLOSED}) AS shut, {since(_CLOSED)} AS s_since, {ahead(_CLOSED)} AS s_ahead, date - MIN(CASE WHEN avg_sell_price IS NOT NULL THEN date END) OVER (PARTITION BY series_id) AS age FROM p),
e AS (SELECT * REPLACE (CASE WHEN shut THEN 0.0 ELSE sales END AS sales, CASE WHEN shut THEN 0.0 ELSE gross_sales END AS gross_sales), CASE WHEN shut THEN 1 ELSE 0 END AS is_store_closed,
    CASE WHEN age >= 0 THEN age END AS days_since_release FROM closing)"""


def split_dates(valid_days: int, test_days: int, source: str = "e") -> str:
    return f"""bounds AS (SELECT MAX(date) - {test_days - 1} AS test_start, MAX(date) - {test_days - 1} - {valid_days} AS valid_start FROM {source}),
train AS (SELECT t.* FROM {source} t, bounds WHERE date < valid_start), valid AS (SELECT t.* FROM {source} t, bounds WHERE date >= valid_start AND date < test_start),
test AS (SELECT t.* FROM {source} t, bounds WHERE date >= test_start)"""
