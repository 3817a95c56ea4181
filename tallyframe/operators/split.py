"""Splits in time, blocks of a horizon, and masks for what a forecast couldn't know."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.config import BLOCK, PERIOD_DAYS, VALID_BLOCKS

LAG_FAMILIES = ("lag", "rolling_", "expanding_", "seasonal_", "momentum_")


@dataclass(frozen=True)
class Split:
    """train < valid_start <= valid < test_start <= test."""

    first: dt.date
    last: dt.date
    valid_start: dt.date
    test_start: dt.date

    def label(self, date: str = "date") -> Column:
        d = F.col(date)
        return F.when(d < F.lit(self.valid_start), "train").when(d < F.lit(self.test_start), "valid").otherwise("test")

    def train(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("date") < F.lit(self.valid_start))

    def valid(self, df: DataFrame) -> DataFrame:
        return df.where((F.col("date") >= F.lit(self.valid_start)) & (F.col("date") < F.lit(self.test_start)))

    def test(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("date") >= F.lit(self.test_start))

    @property
    def days(self) -> tuple[int, int, int]:
        return (self.valid_start - self.first).days, (self.test_start - self.valid_start).days, (self.last - self.test_start).days + 1


def block_days(grain: str, blocks: int = 1) -> int:
    return BLOCK[grain] * PERIOD_DAYS[grain] * blocks


def date_split(df: DataFrame, valid_days: int, test_days: int, test_start: dt.date | None = None, tail_reserve_days: int = 0) -> Split:
    """Bounds from the panel's first and last date. test_start fixes the border; tail_reserve_days are left out at the end."""
    ends = df.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    last = ends.b - dt.timedelta(days=tail_reserve_days)
    test_start = test_start or last - dt.timedelta(days=test_days - 1)
    return Split(ends.a, last, test_start - dt.timedelta(days=valid_days), test_start)


def default_split(df: DataFrame, grain: str) -> Split:
    """A year of blocks for validation, one block for testing."""
    return date_split(df, block_days(grain, VALID_BLOCKS), block_days(grain))


def valid_blocks(start: dt.date, end: dt.date, grain: str) -> list[tuple[int, dt.date, dt.date]]:
    """(number, start, end) of the blocks that cover [start, end); the last may be shorter."""
    step, out = dt.timedelta(days=block_days(grain)), []
    while start < end:
        out.append((len(out), start, min(start + step, end)))
        start = out[-1][2]
    return out


def block_origin(start: dt.date, grain: str, date: str = "date") -> Column:
    """The last known date for a row: one period before its block, where blocks begin at start and repeat."""
    days = block_days(grain)
    offset = F.floor(F.datediff(date, F.lit(start)) / days).cast("int") * days
    return F.date_add(F.lit(start), offset - PERIOD_DAYS[grain])


def horizon(start: dt.date, grain: str, date: str = "date") -> Column:
    """Periods from a row's origin to the row."""
    return F.floor(F.datediff(date, block_origin(start, grain, date)) / PERIOD_DAYS[grain]).cast("int")


def anchor(column: str) -> int | None:
    """The shortest lag in a column's name."""
    found = re.findall(r"lag(\d+)", column)
    return min(map(int, found)) if found else None


def mask_horizon(df: DataFrame, start: dt.date, grain: str) -> DataFrame:
    """Null every column of a lag family whose anchor is shorter than the row's horizon."""
    df = df.withColumn("__h", horizon(start, grain))
    masked = {c: F.when(F.col("__h") <= anchor(c), F.col(c)) for c in df.columns if c.startswith(LAG_FAMILIES) and anchor(c) is not None}
    return df.withColumns(masked).drop("__h")


def masked_split(df: DataFrame, split: Split, grain: str) -> DataFrame:
    """All rows with a ``split`` label; validation and test rows masked block by block, training rows not at all."""
    parts = [split.train(df), mask_horizon(split.valid(df), split.valid_start, grain), mask_horizon(split.test(df), split.test_start, grain)]
    return parts[0].withColumn("split", F.lit("train")).unionByName(parts[1].withColumn("split", F.lit("valid"))).unionByName(parts[2].withColumn("split", F.lit("test")))


def rolling_folds(df: DataFrame, split: Split, grain: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(train, masked validation), oldest first. The last is the split's own; the others step back a block each from its start."""
    step, out = dt.timedelta(days=block_days(grain)), []
    known = split.train(df)
    for back in range(folds - 1, 0, -1):
        start = split.valid_start - back * step
        own = known.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(start + step)))
        out.append((known.where(F.col("date") < F.lit(start)), mask_horizon(own, start, grain)))
    return [*out, (known, mask_horizon(split.valid(df), split.valid_start, grain))]


def truncate_end(df: DataFrame, end: dt.date) -> DataFrame:
    return df.where(F.col("date") <= F.lit(end))
