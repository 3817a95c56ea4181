"""Readers and writers: CSV with given schemas, archives, DDL scripts, Parquet datasets by level, and their checks."""

from __future__ import annotations

import json
import logging
import re
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.config import BY_ID, Level
from tallyframe.operators.features import downcast
from tallyframe.operators.split import LAG_FAMILIES
from tallyframe.sources.store import Folder, FolderHandler

IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
CALENDAR = "date date, wm_yr_wk int, weekday string, wday int, month int, year int, d string, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int"
PRICES = "store_id string, item_id string, wm_yr_wk int, sell_price double"
FILE_NAME = re.compile(r"level_(\d+)_(daily|weekly)_(.+?)(?:\.parquet)?$")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the one that driver and executors share; our own where none is set. It goes with the driver's JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/tallyframe"
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header under a given schema: nothing is inferred, so nothing is read twice."""
    return spark.read.schema(schema).csv(path, header=True)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """The wide sales file: id columns as text and every other column as a day's units. The header is read first."""
    header = spark.read.text(path).first()[0].split(",")
    return read_csv(spark, path, ", ".join(f"`{c}` {'string' if c in IDS else 'int'}" for c in header))


def unpivot_days(wide: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """One row for each id and day column; cells without a value go."""
    days = [c for c in wide.columns if c not in ids]
    return wide.unpivot([c for c in ids if c in wide.columns], days, "d", "sales").where("sales is not null")


def unzip(archive: str, folder: str) -> list[str]:
    """Unpack an archive that lies on the driver; its members' paths."""
    with zipfile.ZipFile(archive) as z:
        root = Path(folder).resolve()
        for name in z.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} would leave {folder}")
        z.extractall(folder)
        return [str(root / x) for x in z.namelist() if not x.endswith("/")]


def run_script(spark: SparkSession, script: str) -> None:
    """Statements that a semicolon ends, one after the other."""
    for statement in script.split(";"):
        if statement.strip():
            spark.sql(statement)


def table_counts(spark: SparkSession) -> dict[str, int]:
    return {t.name: spark.table(t.name).count() for t in spark.catalog.listTables()}


def replace_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        spark.catalog.dropTempView(name)
        df.createOrReplaceTempView(name)


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are null in a part or occur more than once: what a primary key would refuse."""
    nulls = [F.col(k).isNull() for k in key]
    some = nulls[0]
    for x in nulls[1:]:
        some = some | x
    return df.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | some)


def orphans(df: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Keys without a row in parent: what a foreign key would refuse."""
    return df.select(*key).distinct().join(parent.select(*key).distinct(), key, "left_anti")


def read_dataset(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """A Parquet dataset, filtered in the scan, with floats for doubles."""
    df = spark.read.parquet(path)
    return downcast(df.where(where) if where else df)


def read_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def write_dataset(df: DataFrame, path: str, level: Level, partition: bool = True) -> None:
    """A level's dataset, by its split columns; rows of a partition are gathered, so it has few files whatever its size.

    Rebalancing splits a large partition's rows over tasks, so nothing depends on a threshold of rows.
    """
    by = list(level.split_by) if partition else []
    out = downcast(df)
    if by:
        out = out.hint("rebalance", *by)
    (out.write.partitionBy(*by) if by else out.write).mode("overwrite").option("compression", "zstd").parquet(path)


def split_column(df: DataFrame, level: Level) -> str | None:
    """The column to divide a level's work by: the store, else the state if there are several."""
    for column in ("store_id", "state_id"):
        if column in level.dims and df.select(column).distinct().limit(2).count() > 1:
            return column
    return None


def split_values(df: DataFrame, level: Level) -> DataFrame:
    return df.select(*level.split_by).distinct().orderBy(*level.split_by)


def parse_name(name: str) -> tuple[Level, str]:
    """Level and grain of a dataset's file name."""
    found = FILE_NAME.search(name.rstrip("/").rsplit("/", 1)[-1])
    if not found:
        raise ValueError(f"no level and grain in {name!r}")
    return BY_ID[int(found[1])], found[2]


def with_origin(df: DataFrame) -> DataFrame:
    """Add level and grain from the name of the file that a row comes from."""
    name = F.input_file_name()
    return df.withColumns({"level": F.regexp_extract(name, r"level_(\d+)_", 1).cast("int"), "grain": F.regexp_extract(name, r"level_\d+_(daily|weekly)_", 1)})


def feature_columns(df: DataFrame, target: str = "sales") -> tuple[list[str], list[str]]:
    """Features of a dataset, and those among them that are categories: all but keys, the target and what is only known after."""
    hidden = {"series_id", "date", target, "sales", "gross_sales", "split", "is_store_closed"}
    names = [c for c in df.columns if c not in hidden]
    return names, [c for c, t in df.dtypes if c in names and t == "string"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _file(path: str) -> tuple[Folder, str]:
    folder, _, name = path.rpartition("/")
    return Folder(folder or "."), name


def write_json(values: dict, path: str) -> None:
    """Metrics of a run: a few numbers."""
    folder, name = _file(path)
    folder.write(name, json.dumps(values, indent=2, sort_keys=True))


def write_test_set(df: DataFrame, path: str) -> None:
    """Dimensions and forecasts of a level's test rows."""
    df.select("series_id", "item_id", "dept_id", "cat_id", "store_id", "state_id", "date", "sales", F.rint("forecast").alias("forecast")).write.mode("overwrite").parquet(path)


def log_to(path: str, name: str = "tallyframe") -> logging.Logger:
    """One log file for a run."""
    logger = logging.getLogger(name)
    handler = FolderHandler(*_file(path))
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logger.addHandler(handler)
    logger.setLevel(logging.INFO)
    return logger


def lag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(LAG_FAMILIES)]
