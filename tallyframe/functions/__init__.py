"""Column functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES, DATE = "series_id", "date"


def by_date(*more: str) -> WindowSpec:
    """Rows of a series in order of date; the series leads every partition key, so all such windows share one exchange."""
    return Window.partitionBy(SERIES, *more).orderBy(DATE)


def up_to_yesterday(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def up_to_today(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def floor_zero(x: Column) -> Column:
    """x, but at least 0; null stays null."""
    return F.when(x < 0, F.lit(0)).otherwise(x)


def days_since_last(event: Column, date: str = DATE) -> Column:
    """Days since the last row, this one included, at which event was true."""
    marked = F.when(event, F.col(date))
    return F.datediff(F.col(date), F.last(marked, ignorenulls=True).over(up_to_today(by_date())))


def days_to_next(event: Column, date: str = DATE) -> Column:
    """Days to the next row, this one included, at which event is true."""
    marked = F.when(event, F.col(date))
    ahead = by_date().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return F.datediff(F.first(marked, ignorenulls=True).over(ahead), F.col(date))
