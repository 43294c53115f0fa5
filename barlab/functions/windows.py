"""Row windows by symbol. All of them share one partitioning and order, so Spark makes one exchange and one sort for any number of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec, functions as F


def by_symbol(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def last(n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def full(n: int, agg: Callable[[Column], Column], arg: Column) -> Column:
    """The aggregate of the last n values; null until n of them are not null."""
    return F.when(F.count(arg).over(last(n)) == n, agg(arg).over(last(n)))


def running(*keys: str, order: str = "date") -> WindowSpec:
    return by_symbol(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0, never an infinity."""
    return F.try_divide(a, b)
