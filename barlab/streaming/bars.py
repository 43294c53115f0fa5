"""Streams of closed bars and quotes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from barlab.operators import quality


def dedup_ticks(ticks: DataFrame, *, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Ticks without repeats of their keys within the watermark."""
    return ticks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_bars(ticks: DataFrame, *, width: str = "1 day", delay: str | None = "1 hour", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Bars of closed windows from a stream (or table) with symbol, price, volume, ``ts`` and ``order``.

    In append mode a bar leaves only when the watermark has passed its end, so
    an unfinished day never gets out; ticks that come later than ``delay`` are
    dropped and past bars are not revised. ``delay`` None: the stream has its
    watermark already, as after dedup_ticks.
    """
    streamed = ticks.withWatermark(ts, delay) if ticks.isStreaming and delay else ticks
    key = F.struct(ts, order)
    got = streamed.groupBy("symbol", F.window(ts, width).alias("w")).agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("volume").alias("volume"))
    return got.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The last price received for each symbol."""
    return quotes.groupBy("symbol").agg(F.max_by("price", "received_at").alias("quote"), F.max("received_at").alias("received_at"))


def with_quotes(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Bars with the last quote beside them; without one they stay as they are, and no feature reads it."""
    return bars.join(latest_quotes(quotes), "symbol", "left")


def swap_on_complete(path: str, refresh: Callable[[DataFrame, DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a batch of bars is validated as a whole and only then appended; ``refresh`` gets the touched symbols.

    An invalid batch, also one with a bar that an earlier batch has stored,
    raises before anything is written, so what is there stays. The batch's
    number is a partition of the output, so a repeated batch replaces itself.
    """

    def stored_before(batch: DataFrame, number: int) -> bool:
        spark = batch.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return False
        earlier = spark.read.parquet(path).where(F.col("batch") != number)
        return not earlier.join(batch.select("symbol", "date"), ["symbol", "date"], "left_semi").isEmpty()

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if not quality.rejects(batch).isEmpty() or not quality.duplicate_dates(batch).isEmpty() or stored_before(batch, number):
                raise ValueError(f"batch {number} holds invalid bars")
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            if refresh is not None:
                refresh(batch.select("symbol").distinct(), batch)
        finally:
            batch.unpersist()

    return sink
