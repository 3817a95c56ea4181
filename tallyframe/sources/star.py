"""The star schema that panels are built from: a daily sales fact, a calendar and a weekly price table.

The fact comes from order lines: item = part, category = part type, department = type and brand, store = supplier, state = region of
the supplier's nation.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order lines of a portion. A task has one portion, so what it holds doesn't grow with the input.
PORTION = 250_000
#: Portions that the lines of an item are dealt over, so that an item which many lines share isn't one task's.
SALTS = 8
#: Stores that are broadcast; more are dealt like the items.
FEW_STORES = 1_000_000
#: The Saturday that retail week 1 begins on.
WEEK_ONE = "1994-12-31"
#: Event name, type, and the days it falls on (month, first and last day of month, weekday: 0 = Monday, null = any).
EVENTS = (
    ("NewYear", "National", 1, 1, 1, None),
    ("OrthodoxChristmas", "Religious", 1, 7, 7, None),
    ("SuperBowl", "Sporting", 2, 1, 7, 6),
    ("ValentinesDay", "Cultural", 2, 14, 14, None),
    ("Mother's day", "Cultural", 5, 8, 14, 6),
    ("Father's day", "Cultural", 6, 15, 21, 6),
    ("IndependenceDay", "National", 7, 4, 4, None),
    ("LaborDay", "National", 9, 1, 7, 0),
    ("Halloween", "Cultural", 10, 31, 31, None),
    ("Thanksgiving", "National", 11, 22, 28, 3),
    ("Christmas", "National", 12, 25, 25, None),
)
#: A second event, which may fall on the day of a first one.
SECOND = ("NBAFinalsEnd", "Sporting", 6, 18, 18, None)
#: Days of the month with food assistance, by state.
SNAP = {"AFRICA": (1, 5), "AMERICA": (1, 10), "ASIA": (3, 12), "EUROPE": (5, 14), "MIDDLE EAST": (11, 15)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_week(date: Column) -> Column:
    return F.floor(F.datediff(date, F.lit(WEEK_ONE).cast("date")) / 7).cast("int") + 1


def day_id(date: Column) -> Column:
    return F.concat(F.lit("d_"), (F.datediff(date, F.lit(WEEK_ONE).cast("date")) + 1).cast("string"))


def portions(spark: SparkSession, sf_dir: str, share: int = 1) -> int:
    """Portions, or shares of them, to deal the fact to: in proportion to its lines, which the files' footers count; a task a core for few lines."""
    lines = read(spark, sf_dir, "lineitem").count()
    return max(1, ceil(lines * share / PORTION), min(spark.sparkContext.defaultParallelism, ceil(lines / 10_000)))


def _place(key: str, salt: Column, n: int) -> Column:
    """The portion, one of n, of a key and a salt; salts of a key differ in it. How many portions there are goes with the column."""
    return F.pmod(F.hash(key).cast("long") + salt, F.lit(n)).cast("int").alias("slot", metadata={"portions": n})


def _deal(rows: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """Rows by slot: a portion each, which adaptive plans neither join nor split."""
    place = _place(key, F.pmod(F.hash(other), F.lit(min(SALTS, n))), n)
    return rows.select(*(c for c in rows.columns if c != "slot"), place).repartitionById(n, F.col("slot"))


def _meet(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """Dealt rows with those of a table of one row a key, which is dealt to every slot that the key has. A hash table of a slot's part is small."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(min(SALTS, n) - 1)))
    # rows are dealt once before there are copies of them, lest a task of a large file's rows holds all their copies for the exchange
    table = table.repartition(n, key).withColumn("salt", salts).select(*table.columns, _place(key, F.col("salt"), n)).repartitionById(n, F.col("slot"))
    return rows.join(table.hint("shuffle_hash"), ["slot", key])


def _dimensions(spark: SparkSession, sf_dir: str, rows: DataFrame, n: int) -> DataFrame:
    """Rows that are dealt by l_partkey, with dept_id, cat_id and state_id."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cat_id"), F.concat_ws("_", "p_type", "p_brand").alias("dept_id"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 nations, 5 regions
    supplier = read(spark, sf_dir, "supplier")
    store = supplier.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("state_id"))
    rows = _meet(rows, part, "l_partkey", n)
    if supplier.count() <= FEW_STORES:
        return rows.join(F.broadcast(store), "l_suppkey")
    return _meet(_deal(rows, "l_suppkey", "l_partkey", n), store, "l_suppkey", n)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id columns, d, date, sales (units), paid (revenue) and sell_price (what a unit cost in that retail week), one row for each item,
    store and day with sales."""
    return sales_by_slot(spark, sf_dir).drop("slot")


def sales_by_slot(spark: SparkSession, sf_dir: str, share: int = 1) -> DataFrame:
    """sales, partitioned by a column slot: the portion, or share of one, that a row was dealt to."""
    n = portions(spark, sf_dir, share)
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_extendedprice")
    # one exchange, by item and store, serves the daily sums, the weekly price and the items; the dimensions depend on the keys only, so
    # it comes before the joins and carries six columns. Items sell about one line a store and day, so there is nothing to combine before it.
    lines = _deal(lines, "l_partkey", "l_suppkey", n)
    daily = lines.groupBy("slot", "l_partkey", "l_suppkey", "date").agg(F.sum("l_quantity").alias("sales"), F.sum("l_extendedprice").alias("paid"))
    week = Window.partitionBy("slot", "l_partkey", "l_suppkey", "wm_yr_wk")
    daily = daily.withColumn("wm_yr_wk", retail_week(F.col("date"))).withColumn("sell_price", F.try_divide(F.sum("paid").over(week), F.sum("sales").over(week)))
    return _dimensions(spark, sf_dir, daily, n).select(
        F.col("l_partkey").cast("string").alias("item_id"), "dept_id", "cat_id", F.col("l_suppkey").cast("string").alias("store_id"), "state_id",
        day_id(F.col("date")).alias("d"), "date", "sales", "paid", "sell_price", "slot",
    )


def series_by_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id columns and slot of every item and store with sales, once each: no sums, dates or prices."""
    n = portions(spark, sf_dir)
    pairs = _deal(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", n).distinct()
    return _dimensions(spark, sf_dir, pairs, n).select(F.col("l_partkey").cast("string").alias("item_id"), "dept_id", "cat_id", F.col("l_suppkey").cast("string").alias("store_id"), "state_id", "slot")


def _falls(event: tuple) -> Column:
    _, _, month, first, last, weekday = event
    on = (F.month("date") == month) & F.dayofmonth("date").between(first, last)
    return on if weekday is None else on & (F.weekday("date") == weekday)


def _named(events: tuple, field: int) -> Column:
    out = F.lit(None).cast("string")
    for event in reversed(events):
        out = F.when(_falls(event), F.lit(event[field])).otherwise(out)
    return out


def calendar_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a day: date, wm_yr_wk, weekday, wday, month, year, d, two events with types, and a snap flag for each state."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    first_event, second = _named(EVENTS, 0), _falls(SECOND)
    flags = [F.dayofmonth("date").between(a, b).cast("int").alias("snap_" + state.replace(" ", "_")) for state, (a, b) in SNAP.items()]
    return days.select(
        "date", retail_week(F.col("date")).alias("wm_yr_wk"), F.date_format("date", "EEEE").alias("weekday"), (F.weekday("date") + 1).alias("wday"),
        F.month("date").alias("month"), F.year("date").alias("year"), day_id(F.col("date")).alias("d"),
        F.coalesce(first_event, F.when(second, F.lit(SECOND[0]))).alias("event_name_1"), F.coalesce(_named(EVENTS, 1), F.when(second, F.lit(SECOND[1]))).alias("event_type_1"),
        F.when(second & first_event.isNotNull(), F.lit(SECOND[0])).alias("event_name_2"), F.when(second & first_event.isNotNull(), F.lit(SECOND[1])).alias("event_type_2"),
        *flags,
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of the days that the fact spans."""
    ends = read(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").cast("date").cast("string").alias("a"), F.max("l_shipdate").cast("date").cast("string").alias("b")).first()
    return calendar_between(spark, ends.a or "1995-01-02", ends.b or "1995-01-01") if ends.a else calendar_between(spark, "1995-01-02", "1995-01-02").limit(0)


def prices(fact: DataFrame) -> DataFrame:
    """store_id, item_id, wm_yr_wk, sell_price: what a unit cost in that retail week."""
    return fact.groupBy("store_id", "item_id", retail_week(F.col("date")).alias("wm_yr_wk")).agg(F.try_divide(F.sum("paid"), F.sum("sales")).alias("sell_price"))


def snap_of(state: str | Column = "state_id") -> Column:
    """The calendar's flag of the row's state; null for a state without one."""
    state = F.col(state) if isinstance(state, str) else state
    out = F.lit(None).cast("int")
    for name in SNAP:
        out = F.when(state == name, F.col("snap_" + name.replace(" ", "_"))).otherwise(out)
    return out


def joined(spark: SparkSession, sf_dir: str, days: DataFrame | None = None, share: int = 1) -> DataFrame:
    """The fact by slot, with its calendar row and its price. days: the calendar, if at hand. share: slots of a portion of lines.

    The price of an item in a store and week is brought along by the fact, which it is derived from; only the calendar is joined.
    """
    fact, days = sales_by_slot(spark, sf_dir, share), calendar(spark, sf_dir) if days is None else days
    return fact.drop("date").join(F.broadcast(days), "d", "left")


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denormalised base table."""
    rows = joined(spark, sf_dir)
    return rows.select(
        F.concat_ws("_", "item_id", "store_id").alias("series_id"), "state_id", "store_id", "cat_id", "dept_id", "item_id", "date", "sell_price", "sales",
        (F.coalesce("sales", F.lit(0.0)) * F.col("sell_price")).alias("mnt_gross_sales"), snap_of().alias("snap"),
        F.coalesce("event_name_1", "event_name_2").alias("event_name"), F.coalesce("event_type_1", "event_type_2").alias("event_type"),
    )
