"""Bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bars_from_ticks(ticks: DataFrame, *, symbol: Column, day: Column, price: Column, volume: Column, order: list[Column]) -> DataFrame:
    """Daily bars: first, largest, smallest and last price and summed volume by symbol and day.

    ``order`` must order the ticks of a day totally. Every aggregate combines
    before the shuffle, so a symbol with most of the ticks costs a row per day
    and task. Ticks without symbol, day or price are left out.
    """
    plain = ticks.select(symbol.cast("string").alias("symbol"), day.cast("date").alias("date"), price.cast("double").alias("p"), volume.cast("double").alias("v"), F.struct(*order).alias("k"))
    known = plain.where("symbol IS NOT NULL AND date IS NOT NULL AND p IS NOT NULL")
    return known.groupBy("symbol", "date").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("v").alias("volume"),
    )
