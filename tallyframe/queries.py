"""The registered queries and their SQL twins. Every query reads whole tables below sf_dir."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import oracle as o
from tallyframe.config import BY_NAME, DIMS, GRAINS, LEVELS
from tallyframe.operators import analytics, features
from tallyframe.plans import panel as plans
from tallyframe.sources import files, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Doubles rounded, as the SQL twins round them: a little is added first, so that exact halves go the same way in either engine."""

    def near(c: str) -> Column:
        d = own.get(c, digits)
        return (F.round(F.col(c) + F.lit(float(f"3e-{d + 4}")), d) + F.lit(0.0)).alias(c)

    return df.select(*(near(c) if t == "double" else F.col(c) for c, t in df.dtypes))


MONEY = {"sales": 2, "gross_sales": 2}


def _panel(level: str, grain: str) -> Query:
    return lambda spark, sf_dir: rounded(plans.panel(spark, sf_dir, level, grain), **MONEY)


for _level in LEVELS:
    for _grain in GRAINS:
        register(f"panel_{_level.name}_{_grain}", o.panel_sql(_level.name, _grain))(_panel(_level.name, _grain))


# sources ----------------------------------------------------------------------------------------------------------------------
LEVEL, GRAIN = "state_cat", "daily"
S = f"WITH {o.STAR}"


def _dense(spark: SparkSession, sf_dir: str, level: str = LEVEL, grain: str = GRAIN) -> DataFrame:
    return plans.dense_panel(spark, sf_dir, level, grain)


def _evented(spark: SparkSession, sf_dir: str, level: str = LEVEL, grain: str = GRAIN) -> DataFrame:
    return features.event_features(_dense(spark, sf_dir, level, grain))


@register("scan_csv", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, " + o.r("c_acctbal", 2) + " FROM customer")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "csv")
    files.write_csv(star.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return rounded(files.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double"), 2)


@register("scan_parquet_lazy", f"SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n, {o.r('MAX(CAST(value AS FLOAT))', 2, 'top')} FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'view' GROUP BY event_type")
def scan_parquet_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_dataset(spark, f"{sf_dir}/events.parquet", "ts >= timestamp '2024-01-10' AND event_type <> 'view'")
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").cast("double").alias("top")), 2)


@register("run_ddl", "SELECT 'suppliers' AS name, CAST(COUNT(*) AS BIGINT) AS n FROM supplier UNION ALL SELECT 'rich', COUNT(*) FROM supplier WHERE s_acctbal > 5000")
def run_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.replace_views(spark, {"__supplier": star.read(spark, sf_dir, "supplier")})
    files.run_script(spark, "CREATE OR REPLACE TEMP VIEW suppliers AS SELECT * FROM __supplier; CREATE OR REPLACE TEMP VIEW rich AS SELECT * FROM suppliers WHERE s_acctbal > 5000;")
    return spark.table("suppliers").agg(F.count("*").alias("n")).select(F.lit("suppliers").alias("name"), "n").unionByName(spark.table("rich").agg(F.count("*").alias("n")).select(F.lit("rich").alias("name"), "n"))


@register("primary_key_check", "SELECT l_orderkey, l_linenumber, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL")
def primary_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.key_violations(star.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("foreign_key_check", "SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def foreign_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = star.read(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("key"))
    return files.orphans(star.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")), parts, ["key"])


@register("sink_split", f"{S}, {o.sparse('item_state', 'weekly')} SELECT state_id, dept_id, CAST(COUNT(*) AS BIGINT) AS n, {o.r('SUM(sales)', 2, 'sales')} FROM base GROUP BY ALL")
def sink_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = BY_NAME["item_state"]
    path = files.scratch(spark, "datasets") + f"/{level.label('weekly')}"
    files.write_dataset(plans.aggregate(star.joined(spark, sf_dir), level, "weekly"), path, level)
    return rounded(spark.read.parquet(path).groupBy("state_id", "dept_id").agg(F.count("*").alias("n"), F.sum(F.col("sales").cast("double")).alias("sales")), 2)


@register("parse_level_file", f"{S}, {o.sparse('cat', 'weekly')} SELECT 3 AS level, 'weekly' AS grain, CAST(COUNT(*) AS BIGINT) AS n FROM base")
def parse_level_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = BY_NAME["cat"]
    path = files.scratch(spark, "datasets") + f"/{level.label('weekly')}"
    files.write_dataset(plans.aggregate(star.joined(spark, sf_dir), level, "weekly"), path, level)
    return files.with_origin(spark.read.parquet(path)).groupBy("level", "grain").agg(F.count("*").alias("n"))


# projections ------------------------------------------------------------------------------------------------------------------
@register("calendar", f"{S} SELECT * FROM cal")
def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.calendar(spark, sf_dir)


@register("dataset_raw", f"{S}, {o.DATASET} SELECT series_id, state_id, store_id, cat_id, dept_id, item_id, date, {o.r('sell_price')}, {o.r('sales', 2)}, {o.r('mnt_gross_sales', 2)}, {o.i('snap')}, event_name, event_type FROM dataset")
def dataset_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(star.dataset(spark, sf_dir), sales=2, mnt_gross_sales=2)


_ALL_DAYS = f"{S}, f AS (SELECT cat_id, d, SUM(sales) AS sales FROM fact JOIN cal USING (date) GROUP BY ALL) SELECT cat_id, d, {o.r('sales', 2)} FROM f"


@register("unpivot", _ALL_DAYS)
@register("unpivot_all_days", _ALL_DAYS)
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for every day between the fact's first and last date, turned back to rows."""
    days = [r.d for r in star.calendar(spark, sf_dir).select("d").orderBy("date").collect()]
    wide = star.sales(spark, sf_dir).groupBy("cat_id").pivot("d", days).agg(F.sum("sales"))
    return rounded(files.unpivot_days(wide, ("cat_id",)), 2)


@register("in_filter", o.panel_sql("store_dept", "weekly", "WHERE state_id IN ('ASIA', 'EUROPE') AND cat_id IN (SELECT MIN(p_type) FROM part)"))
def in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = star.read(spark, sf_dir, "part").agg(F.min("p_type").alias("t")).first().t
    return rounded(plans.panel(spark, sf_dir, "store_dept", "weekly", {"state_id": ("ASIA", "EUROPE"), "cat_id": (first,)}), **MONEY)


@register("date_range_filter", f"{S} SELECT date, {o.r('SUM(sales)', 2, 'sales')} FROM fact WHERE date >= DATE '1997-01-01' AND date < DATE '1998-01-01' GROUP BY date")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.sales(spark, sf_dir).where("date >= date '1997-01-01' AND date < date '1998-01-01'")
    return rounded(rows.groupBy("date").agg(F.sum("sales").alias("sales")), 2)


@register("strftime_fmt", f"{S} SELECT strftime(date, '%Y-%m') AS month, strftime(date, '%d') AS day, strftime(date, '%a') AS weekday, {o.r('SUM(sales)', 2, 'sales')} FROM fact GROUP BY ALL")
def strftime_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.date_format("date", f).alias(n) for f, n in (("yyyy-MM", "month"), ("dd", "day"), ("E", "weekday"))]
    return rounded(star.sales(spark, sf_dir).groupBy(*keys).agg(F.sum("sales").alias("sales")), 2)


@register("str_extract", f"{S} SELECT CAST(regexp_extract(d, '([0-9]+)', 1) AS INTEGER) AS number, split_part(weekday, 'd', 1) AS head, regexp_replace(COALESCE(event_name_1, 'none (bench)'), ' *[(]bench[)]$', '') AS name FROM cal")
def str_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = star.calendar(spark, sf_dir)
    name = F.regexp_replace(F.coalesce("event_name_1", F.lit("none (bench)")), r" *\(bench\)$", "")
    return days.select(F.regexp_extract("d", r"(\d+)", 1).cast("int").alias("number"), F.split("weekday", "d")[0].alias("head"), name.alias("name"))


@register("missing_ids", "WITH o AS (SELECT DISTINCT o_orderstatus, o_custkey FROM orders), s AS (SELECT o_orderstatus, MIN(o_custkey) AS a, MAX(o_custkey) AS z FROM o GROUP BY 1), g AS (SELECT o_orderstatus, UNNEST(generate_series(a, z)) AS number FROM s) SELECT o_orderstatus, number FROM g ANTI JOIN o ON g.o_orderstatus = o.o_orderstatus AND g.number = o.o_custkey")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.missing_numbers(star.read(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@register("log1p_expm1", f"SELECT o_orderstatus, {o.r('AVG(LN(1 + o_totalprice))', 6, 'mean_log')}, {o.r('EXP(AVG(LN(1 + o_totalprice))) - 1', 3, 'back')} FROM orders GROUP BY 1")
def log1p_expm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg(F.log1p("o_totalprice")).alias("mean_log"))
    return rounded(rows.withColumn("back", F.expm1("mean_log")), 6, back=3)


@register("round_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round_even(l_quantity / 2, 0) + 0.0 AS half FROM lineitem")
def round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.rint(F.col("l_quantity") / 2) + F.lit(0.0)).alias("half"))


@register("semi_in_subquery", f"{S} SELECT {o.b('COUNT(*)', 'n')} FROM cal WHERE d IN (SELECT DISTINCT c.d FROM fact f JOIN cal c USING (date) WHERE f.state_id = 'ASIA')")
def semi_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = star.sales(spark, sf_dir).where("state_id = 'ASIA'").select("d")
    return star.calendar(spark, sf_dir).join(sold, "d", "left_semi").agg(F.count("*").alias("n"))


# aggregates -------------------------------------------------------------------------------------------------------------------
_SETS = " UNION ALL ".join(
    f"SELECT {x.id} AS level, " + (f"concat_ws('_', {', '.join(x.dims)})" if x.dims else "'TOTAL'") + f" AS series_id, MIN(date) AS date, {o.r('SUM(sales)', 2, 'sales')}, {o.r('SUM(sales * sell_price)', 2, 'gross_sales')}, {o.r('SUM(sales * sell_price) / NULLIF(SUM(sales), 0)', 4, 'avg_sell_price')} FROM joined GROUP BY {''.join(d + ', ' for d in x.dims)}date_trunc('week', date)"
    for x in LEVELS
)


@register("level_sets", f"{S} {_SETS}")
def level_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plans.all_levels(spark, sf_dir, "weekly"), **MONEY)


@register("count_distinct_periods", f"{S} SELECT {o.b('COUNT(DISTINCT d)', 'days')}, {o.b('COUNT(DISTINCT wm_yr_wk)', 'weeks')} FROM joined")
def count_distinct_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.sales(spark, sf_dir).agg(F.countDistinct("d").alias("days"), F.countDistinct(star.retail_week(F.col("date"))).alias("weeks"))


_COUNTS = " UNION ALL ".join(f"SELECT {x.id} AS level, '{x.name}' AS name, {o.b('COUNT(*)', 'n')} FROM (SELECT DISTINCT {', '.join(x.dims) or '1'} FROM fact)" for x in LEVELS)


@register("count_series", f"{S} {_COUNTS}")
def count_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest level's combinations are found once and the others counted in them."""
    one = plans.series(spark, sf_dir).agg(*(F.count(F.when(F.col("level") == x.id, 1)).alias(x.name) for x in LEVELS))
    names = F.array(*(F.struct(F.lit(x.id).alias("level"), F.lit(x.name).alias("name"), F.col(x.name).cast("long").alias("n")) for x in LEVELS))
    return one.select(F.inline(names))


@register("size_estimate", f"{S}, c AS ({_COUNTS}) SELECT level, name, n, {o.b('n * (SELECT COUNT(DISTINCT date) FROM fact)', 'daily_rows')}, {o.b('n * (SELECT COUNT(DISTINCT wm_yr_wk) FROM joined)', 'weekly_rows')} FROM c")
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = count_distinct_periods(spark, sf_dir)
    return count_series(spark, sf_dir).join(F.broadcast(periods)).select("level", "name", "n", (F.col("n") * F.col("days")).alias("daily_rows"), (F.col("n") * F.col("weeks")).alias("weekly_rows"))


@register("distinct_combos", f"{S} SELECT DISTINCT state_id, dept_id FROM fact")
def distinct_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_values(star.sales(spark, sf_dir), BY_NAME["item_state"])


@register("multi_distinct_profile", f"{S} SELECT {o.b('COUNT(*)', 'n')}, {', '.join(o.b(f'COUNT(DISTINCT {d})', f'n_{d}') for d in (*DIMS, 'date'))} FROM fact")
def multi_distinct_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.profile(star.sales(spark, sf_dir), [*DIMS, "date"])


@register("group_share", f"{S} SELECT state_id, cat_id, {o.r('SUM(sales)', 2, 'sales')}, {o.r('SUM(sales) / SUM(SUM(sales)) OVER (PARTITION BY state_id)', 6, 'share')} FROM fact GROUP BY state_id, cat_id")
def group_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.group_share(star.sales(spark, sf_dir), ["state_id", "cat_id"], ["state_id"]), 6, sales=2)


@register("global_share", f"{S} SELECT cat_id, {o.r('SUM(sales)', 2, 'sales')}, {o.r('SUM(sales) / SUM(SUM(sales)) OVER ()', 6, 'share')} FROM fact GROUP BY ALL")
def global_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.group_share(star.sales(spark, sf_dir), ["cat_id"], []), 6, sales=2)


_STATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@register("pivot", f"{S} SELECT month(date) AS month, " + ", ".join(o.r(f"COALESCE(SUM(CASE WHEN state_id = '{s}' THEN sales END), 0)", 2, f'"{s}"') for s in _STATES) + " FROM fact GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = analytics.pivot_sum(star.sales(spark, sf_dir).withColumn("month", F.month("date").cast("long")), "month", "state_id", _STATES)
    return rounded(wide, 2)


@register("min_max_count", "SELECT p_type, CAST(MIN(p_size) AS INTEGER) AS least, CAST(MAX(p_size) AS INTEGER) AS most, CAST(COUNT(p_size) AS BIGINT) AS n FROM part GROUP BY ALL")
def min_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.read(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.count("p_size").alias("n"))


_CLASSES = """own AS (SELECT series_id, COUNT(*) AS n_days, COUNT(*) FILTER (WHERE sales > 0) AS n_sold, AVG(sales) FILTER (WHERE sales > 0) AS mean_sold, STDDEV_SAMP(sales) FILTER (WHERE sales > 0) AS std_sold FROM p GROUP BY 1),
ratio AS (SELECT *, n_days / NULLIF(n_sold, 0) AS adi, (std_sold / NULLIF(mean_sold, 0)) * (std_sold / NULLIF(mean_sold, 0)) AS cv2 FROM own),
classes AS (SELECT *, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi >= 1.32 AND cv2 < 0.49 THEN 'intermittent' WHEN adi < 1.32 AND cv2 >= 0.49 THEN 'erratic' WHEN adi >= 1.32 AND cv2 >= 0.49 THEN 'lumpy' END AS demand FROM ratio)"""


def _classes(spark: SparkSession, sf_dir: str, level: str = "state_dept") -> DataFrame:
    return analytics.demand_classes(plans.dense_base(spark, sf_dir, level, GRAIN))


@register("filtered_agg", o.on_dense("state_dept", GRAIN, _CLASSES, f"SELECT series_id, {o.b('n_days')}, {o.b('n_sold')}, {o.r('mean_sold')}, {o.r('std_sold')} FROM classes"))
def filtered_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_classes(spark, sf_dir).select("series_id", "n_days", "n_sold", "mean_sold", "std_sold"))


@register("sbc_class", o.on_dense("state_dept", GRAIN, _CLASSES, f"SELECT series_id, {o.r('adi')}, {o.r('cv2')}, demand FROM classes"))
def sbc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_classes(spark, sf_dir).select("series_id", "adi", "cv2", "demand"))


@register("sbc_summary", o.on_dense("state_dept", GRAIN, _CLASSES, f"SELECT demand, {o.b('COUNT(*)', 'series')}, {o.r('AVG(n_days)', 4, 'n_days')}, {o.r('AVG(n_sold)', 4, 'n_sold')}, {o.r('AVG(mean_sold)', 4, 'mean_sold')}, {o.r('AVG(adi)', 4, 'adi')}, {o.r('AVG(cv2)', 4, 'cv2')}, {o.r('COUNT(*) / SUM(COUNT(*)) OVER ()', 4, 'share')} FROM classes WHERE demand IS NOT NULL GROUP BY demand"))
def sbc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.class_summary(_classes(spark, sf_dir)))


@register("median_distance", o.on_dense("state_dept", GRAIN, _CLASSES, f"SELECT demand, series_id, {o.r('gap')} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY demand ORDER BY gap, series_id) AS k FROM (SELECT *, ABS(n_sold - MEDIAN(n_sold) OVER (PARTITION BY demand)) AS gap FROM classes WHERE demand IS NOT NULL)) WHERE k = 1"))
def median_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.representatives(_classes(spark, sf_dir)).select("demand", "series_id", "gap"))


@register("event_counts", f"{S}, {o.DATASET} SELECT event_name, event_type, {o.b('COUNT(*)', 'n')} FROM dataset WHERE event_name IS NOT NULL GROUP BY ALL")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.event_counts(star.dataset(spark, sf_dir))


@register("event_lift", f"""{S}, {o.DATASET}, daily AS (SELECT date, event_name, SUM(sales) AS sales FROM dataset GROUP BY ALL), n AS (SELECT AVG(sales) AS normal FROM daily WHERE event_name IS NULL),
ev AS (SELECT event_name, COUNT(*) AS n_days, AVG(sales) AS at_event FROM daily WHERE event_name IS NOT NULL GROUP BY 1)
SELECT event_name, {o.b('n_days')}, {o.r('at_event')}, {o.r('normal')}, {o.r('100 * (at_event / NULLIF(normal, 0) - 1)', 4, 'pct_change')} FROM ev CROSS JOIN n""")
def event_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.event_lift(star.dataset(spark, sf_dir)))


@register("event_pre_post", f"""{S}, {o.DATASET}, daily AS (SELECT date, SUM(sales) AS sales, MAX(event_name) AS event_name FROM dataset GROUP BY 1),
m AS (SELECT e.event_name, e.date AS event_date, e.sales AS at_event, AVG(CASE WHEN d.date < e.date THEN d.sales END) AS pre, AVG(CASE WHEN d.date > e.date THEN d.sales END) AS post
FROM daily e JOIN daily d ON d.date BETWEEN e.date - 3 AND e.date + 3 WHERE e.event_name IS NOT NULL GROUP BY ALL)
SELECT event_name, event_date, {o.r('pre')}, {o.r('at_event')}, {o.r('post')}, {o.r('100 * (at_event / NULLIF(pre, 0) - 1)', 4, 'pct_vs_pre')}, {o.r('100 * (post / NULLIF(at_event, 0) - 1)', 4, 'pct_post')} FROM m""")
def event_pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.event_pre_post(star.dataset(spark, sf_dir)))


_TOTAL = "t AS (SELECT date, SUM(sales) AS sales FROM fact GROUP BY 1)"


@register("daily_total_rolling", f"{S}, {_TOTAL} SELECT date, {o.r('sales', 2)}, " + ", ".join(o.r(f"CASE WHEN COUNT(sales) OVER w{w} = {w} THEN AVG(sales) OVER w{w} END", 4, f"mean_{w}") for w in (7, 28, 364)) + " FROM t WINDOW " + ", ".join(f"w{w} AS (ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (7, 28, 364)))
def daily_total_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.total_rolling(star.sales(spark, sf_dir)), sales=2)


@register("asfreq_day", f"SELECT g.date, {o.r('v', 2, 'value')} FROM (SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM x) g LEFT JOIN x ON g.date = x.date".join(["WITH x AS (SELECT CAST(o_orderdate AS DATE) AS date, SUM(o_totalprice) AS v FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 200000 GROUP BY 1) ", ""]))
def asfreq_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.read(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%' AND o_totalprice > 200000").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))
    return rounded(analytics.as_daily(rows, "value"), 2)


@register("autocorrelation", f"{S}, {_TOTAL}, l AS (SELECT sales, " + ", ".join(f"LAG(sales, {k}) OVER (ORDER BY date) AS l{k}" for k in (1, 7, 28, 364)) + " FROM t) " + " UNION ALL ".join(f"SELECT {k} AS lag, {o.r(f'CORR(sales, l{k})', 6, 'acf')} FROM l" for k in (1, 7, 28, 364)))
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.autocorrelation(star.sales(spark, sf_dir)), 6)


@register("partial_autocorrelation")
def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.partial_autocorrelation(star.sales(spark, sf_dir)), 6)


@register("stl")
def stl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly seasons of each state's daily sales."""
    return rounded(analytics.stl(plans.dense_base(spark, sf_dir, "state", "daily").select("series_id", "date", "sales")))


@register("decomposition", f"{S}, {_TOTAL}, c AS (SELECT *, CASE WHEN COUNT(*) OVER w = 7 THEN AVG(sales) OVER w END AS trend FROM t WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), s AS (SELECT *, AVG(sales - trend) OVER (PARTITION BY isodow(date)) AS seasonal FROM c) SELECT date, {o.r('sales', 2)}, {o.r('trend')}, {o.r('seasonal')}, {o.r('sales - trend - seasonal', 4, 'rest')} FROM s")
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.decomposition(star.sales(spark, sf_dir)), sales=2)


# features ---------------------------------------------------------------------------------------------------------------------
def on_events(select: str) -> str:
    return o.on_dense(LEVEL, GRAIN, o.EVENTED, select)


K = ["series_id", "date"]


@register("calendar_features", o.on_dense(LEVEL, GRAIN, "", "SELECT series_id, date, CAST(quarter(date) AS INTEGER) AS quarter, CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end, " + ", ".join(o.r(f"{f}(2 * pi() * ({e} - 1) / {q})", 6, f"{n}_{f.lower()}") for n, e, q in (("dow", "isodow(date)", "7"), ("month", "month(date)", "12"), ("doy", "dayofyear(date)", "365.25::DOUBLE")) for f in ("SIN", "COS")) + " FROM p"))
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.calendar_features(_dense(spark, sf_dir)).select(*K, "quarter", "is_month_start", "is_month_end", *(f"{n}_{f}" for n in ("dow", "month", "doy") for f in ("sin", "cos"))), 6)


@register("price_features", o.on_dense(LEVEL, GRAIN, f"c AS (SELECT *, MAX(avg_sell_price) OVER ({o.W} {o.UP}) AS top, STDDEV_SAMP(avg_sell_price) OVER ({o.W} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS dev, COALESCE(avg_sell_price <> LAG(avg_sell_price) OVER ({o.W}), FALSE) AS moved FROM p)", f"SELECT series_id, date, {o.r('avg_sell_price / NULLIF(top, 0)', 4, 'price_vs_max')}, {o.r('dev', 4, 'price_volatility')}, {o.i(o.since('moved'), 'days_since_price_change')} FROM c"))
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.price_features(_dense(spark, sf_dir)).select(*K, "price_vs_max", "price_volatility", "days_since_price_change"))


def _on(name: str) -> str:
    return f"(COALESCE(event_name_1 = '{name}', FALSE) OR COALESCE(event_name_2 = '{name}', FALSE))"


@register("event_distance", o.on_dense(LEVEL, GRAIN, "", "SELECT series_id, date, " + ", ".join(f"{o.i(f(_on(n)), f'days_{w}_{n.lower()}')}" for n in ("Thanksgiving", "NewYear") for w, f in (("since", o.since), ("to", o.ahead))) + f", {o.i(o.since('has_event = 1 OR has_event_2 = 1'), 'days_since_event')}, {o.i(o.ahead('has_event = 1 OR has_event_2 = 1'), 'days_to_event')} FROM p"))
def event_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evented(spark, sf_dir).select(*K, *(f"days_{w}_{n}" for n in ("thanksgiving", "newyear", "event") for w in ("since", "to")))


_CODE = "CASE {0} WHEN 'Sporting' THEN 1 WHEN 'Cultural' THEN 2 WHEN 'National' THEN 3 WHEN 'Religious' THEN 4 ELSE 0 END AS {0}_enc"


@register("event_type_code", o.on_dense(LEVEL, GRAIN, "", f"SELECT series_id, date, {_CODE.format('event_type_1')}, {_CODE.format('event_type_2')} FROM p"))
def event_type_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evented(spark, sf_dir).select(*K, "event_type_1_enc", "event_type_2_enc")


@register("signed_closure", on_events(f"SELECT series_id, date, is_store_closed, {o.r('sales', 2)}, {o.r('gross_sales', 2)}, CASE WHEN ABS(x) <= 7 THEN CAST(x AS INTEGER) END AS days_to_closure FROM (SELECT *, CASE WHEN s_ahead IS NULL THEN -s_since WHEN s_since IS NULL THEN s_ahead WHEN s_ahead <= s_since THEN s_ahead ELSE -s_since END AS x FROM e)"))
def signed_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evented(spark, sf_dir).select(*K, "is_store_closed", "sales", "gross_sales", "days_to_closure"), 2)


@register("days_since_release", on_events(f"SELECT series_id, date, {o.i('days_since_release')} FROM e"))
def days_since_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evented(spark, sf_dir).select(*K, "days_since_release")


def _te(dim: str) -> str:
    k = dim.removesuffix("_id")
    w = f"OVER (PARTITION BY {dim} ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"
    return f"te_{k} AS (SELECT {dim} AS {dim}_k, date AS {k}_date, AVG(x) {w} AS te_{k}_mean, STDDEV_SAMP(x) {w} AS te_{k}_std, COUNT(x) {w} AS te_{k}_n FROM (SELECT {dim}, date, AVG(sales) AS x FROM e GROUP BY ALL))"


_TES = ", ".join(_te(d) for d in ("item_id", "dept_id", "cat_id")) + ", te AS (SELECT e.*, " + ", ".join(f"te_{k}_{x}" for k in ("item", "dept", "cat") for x in ("mean", "std", "n")) + " FROM e " + " ".join(f"LEFT JOIN te_{k} ON e.{k}_id = te_{k}.{k}_id_k AND e.date = te_{k}.{k}_date" for k in ("item", "dept", "cat")) + ")"


@register("rolling_te", o.on_dense("dept", GRAIN, f"{o.EVENTED}, {_TES}", "SELECT series_id, date, " + ", ".join(o.r(f"te_{k}_{x}") for k in ("item", "dept", "cat") for x in ("mean", "std")) + ", " + ", ".join(o.b(f"te_{k}_n") for k in ("item", "dept", "cat")) + " FROM te"))
def rolling_te(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _evented(spark, sf_dir, "dept")
    for dim in ("item_id", "dept_id", "cat_id"):
        df = features.rolling_encoding(df, dim)
    return rounded(df.select(*K, *(f"te_{k}_{x}" for k in ("item", "dept", "cat") for x in ("mean", "std", "n"))))


@register("bayes_shrink", o.on_dense("dept", GRAIN, f"{o.EVENTED}, {_TES}, s AS (SELECT *, (te_dept_n * te_dept_mean + 10 * te_cat_mean) / (te_dept_n + 10) AS dept FROM te)", f"SELECT series_id, date, {o.r('dept', 4, 'te_dept_mean')}, {o.r('(te_item_n * te_item_mean + 10 * dept) / (te_item_n + 10)', 4, 'te_item_mean')} FROM s"))
def bayes_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.encoding_features(_evented(spark, sf_dir, "dept")).select(*K, "te_dept_mean", "te_item_mean"))


@register("cond_expanding_mean", on_events("SELECT series_id, date, " + ", ".join(o.r(f"AVG(sales) OVER (PARTITION BY series_id, {f} ORDER BY date {o.BEFORE})", 4, n) for f, n in (("is_weekend", "te_weekend_mean"), ("snap", "te_snap_mean"), ("has_event", "te_event_mean"))) + " FROM e"))
def cond_expanding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"te_weekend_mean": "is_weekend", "te_snap_mean": "snap", "te_event_mean": "has_event"}
    return rounded(_evented(spark, sf_dir).withColumns({k: features.conditional_mean(v) for k, v in names.items()}).select(*K, *names))


_INTER = f"""q AS (SELECT *, LAST_VALUE(CASE WHEN sales > 0 THEN date END IGNORE NULLS) OVER ({o.W} {o.BEFORE}) AS sold, SUM(CASE WHEN sales > 0 THEN 1 ELSE 0 END) OVER ({o.W} {o.BEFORE}) AS n_sold,
    AVG(CASE WHEN sales = 0 THEN 1.0 ELSE 0 END) OVER ({o.W} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS z28, AVG(CASE WHEN sales = 0 THEN 1.0 ELSE 0 END) OVER ({o.W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS z90,
    STDDEV_SAMP(sales) OVER ({o.W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS dev, AVG(sales) OVER ({o.W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS avg90 FROM e),
i AS (SELECT *, CASE WHEN sold IS NULL THEN NULL WHEN date - sold - 1 < 0 THEN 0 ELSE date - sold - 1 END AS zero_streak, CASE WHEN days_since_release IS NULL THEN NULL WHEN days_since_release < 1 THEN 0 ELSE days_since_release - 1 END AS age1 FROM q)"""


def on_inter(select: str) -> str:
    return o.on_dense(LEVEL, GRAIN, f"{o.EVENTED}, {_INTER}", select)


def _inter(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return rounded(features.intermittency_features(_evented(spark, sf_dir)).select(*K, *names))


for _name, _columns, _sql in (
    ("zero_streak", ["zero_streak"], o.i("zero_streak")),
    ("pct_zero", ["pct_zero_28", "pct_zero_90"], f"{o.r('z28', 4, 'pct_zero_28')}, {o.r('z90', 4, 'pct_zero_90')}"),
    ("adi_expanding", ["adi_expanding"], o.r("age1 / NULLIF(n_sold, 0)", 4, "adi_expanding")),
    ("cv2_90", ["cv2_90"], o.r("(dev / NULLIF(avg90, 0)) * (dev / NULLIF(avg90, 0))", 4, "cv2_90")),
    ("stockout_flag", ["is_likely_stockout"], "CASE WHEN avg_sell_price IS NOT NULL AND zero_streak >= 7 AND is_store_closed <> 1 THEN 1 ELSE 0 END AS is_likely_stockout"),
):
    register(_name, on_inter(f"SELECT series_id, date, {_sql} FROM i"))(lambda spark, sf_dir, c=tuple(_columns): _inter(spark, sf_dir, *c))


def _lag_sql(name: str) -> str:
    """A lag family column, written out as its own window."""
    if m := re.fullmatch(r"lag(\d+)", name):
        return o.r(f"LAG(sales, {m[1]}) OVER ({o.W})", 4, name)
    if m := re.fullmatch(r"rolling_(\w+)_lag(\d+)_window_size(\d+)", name):
        return o.r(_rolled(m[1], int(m[2]), int(m[3])), 4, name)
    if m := re.fullmatch(r"momentum_lag(\d+)_(\d+)_(\d+)", name):
        k, a, z = map(int, m.groups())
        return o.r(f"({_rolled('mean', k, a)}) / NULLIF({_rolled('mean', k, z)}, 0)", 4, name)
    if m := re.fullmatch(r"expanding_mean_lag(\d+)", name):
        return o.r(f"AVG(sales) OVER ({o.W} ROWS BETWEEN UNBOUNDED PRECEDING AND {m[1]} PRECEDING)", 4, name)
    k, season, count = map(int, re.fullmatch(r"seasonal_mean_lag(\d+)_(\d+)_(\d+)", name).groups())
    return o.r("(" + " + ".join(f"LAG(sales, {k + j * season}) OVER ({o.W})" for j in range(count)) + f") / {count}", 4, name)


def _rolled(stat: str, lag: int, width: int) -> str:
    frame = f"OVER ({o.W} ROWS BETWEEN {lag + width - 1} PRECEDING AND {lag} PRECEDING)"
    f = {"mean": "AVG", "std": "STDDEV_SAMP", "min": "MIN", "max": "MAX"}[stat]
    return f"CASE WHEN COUNT(sales) {frame} = {width} THEN {f}(sales) {frame} END"


def _lag_query(grain: str, pattern: str, level: str) -> tuple[str, Query]:
    names = [n for n in features.lag_names(grain) if re.search(pattern, n)]
    sql = o.on_dense(level, grain, o.EVENTED, "SELECT series_id, date, " + ", ".join(map(_lag_sql, names)) + " FROM e")
    return sql, lambda spark, sf_dir: rounded(features.lag_features(_evented(spark, sf_dir, level, grain), grain, only=pattern).select(*K, *names))


for _name, _grain, _pattern, _level in (
    ("lags_daily", "daily", r"^lag", "cat"),
    ("lags_weekly", "weekly", "", LEVEL),
    ("rolling_lag", "daily", r"^rolling_", "cat"),
    ("momentum", "daily", r"^momentum", LEVEL),
    ("expanding_mean_lag", "daily", r"^expanding", LEVEL),
    ("seasonal_mean_lag", "daily", r"^seasonal", LEVEL),
):
    _sql, _query = _lag_query(_grain, _pattern, _level)
    register(_name, _sql)(_query)


@register("featured_daily")
def featured_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 195 columns."""
    return features.featured(_dense(spark, sf_dir, "cat"), "daily")


@register("featured_weekly")
def featured_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 113 columns."""
    return features.featured(_dense(spark, sf_dir, "state_cat", "weekly"), "weekly")

from tallyframe import queries_forecast as _more  # noqa: E402, F401  registers the queries of splits, forecasts and models
