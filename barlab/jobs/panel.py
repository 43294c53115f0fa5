"""Bars and signals from the given tables.

``lineitem`` plays the ticks. Prices of single ticks are independent draws, so
the bars on which features, labels and backtests run are a random-walk index
of each symbol: its daily return is the day's mean discount around its centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.functions.windows import by_symbol, running
from barlab.operators import features, quality
from barlab.schemas import Protocol
from barlab.sources.ticks import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tick_bars(spark: SparkSession, sf_dir: str, symbol: str = "l_linestatus") -> DataFrame:
    keys = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return bars_from_ticks(table(spark, sf_dir, "lineitem"), symbol=F.col(symbol), day=F.col("l_shipdate"), price=F.col("l_extendedprice"), volume=F.col("l_quantity"), order=keys)


def index_bars(spark: SparkSession, sf_dir: str, symbol: str = "l_linestatus") -> DataFrame:
    exact = lambda c: F.sum(F.col(c).cast("decimal(10,2)")).cast("double")
    n = F.count(F.lit(1))
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col(symbol).alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
        .agg((exact("l_discount") / n - 0.05).alias("r"), (exact("l_tax") / n).alias("t"), F.sum("l_quantity").alias("volume"))
    )
    closed = days.withColumn("close", 100 * F.exp(4 * F.sum("r").over(running())))
    opened = closed.withColumn("open", F.coalesce(F.lag("close").over(by_symbol()), F.lit(100.0)) * (1 + F.col("t") - 0.04))
    return opened.select("symbol", "date", "open", (F.greatest("open", "close") * (1 + F.col("t") / 4)).alias("high"), (F.least("open", "close") * (1 - F.col("t") / 4)).alias("low"), "close", "volume")


def latest_signals(spark: SparkSession, sf_dir: str, p: Protocol = Protocol()) -> DataFrame:
    """The last bar of each symbol with score and target weight, from ticks; features start anew after a gap."""
    bars = quality.contiguous_segments(tick_bars(spark, sf_dir))
    pieces = bars.withColumns({"name": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", "segment")})
    ind = features.indicators(pieces, p).withColumn("symbol", F.col("name")).drop("name", "segment")
    return features.latest_signal(ind, p.lag)
