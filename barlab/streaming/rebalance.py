"""The simulation of backtest.simulate as a keyed stream: the weight held is state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlab.streaming.ingest import state_partitions

REBALANCED = "symbol string, strategy string, date date, return double, weight double, turnover double, event string"
_STATE = "held double, last date, seen timestamp"
_COLUMNS = [c.split()[0] for c in REBALANCED.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def step_days(days: pd.DataFrame, held: float, last, cost: float, band: float) -> tuple[list[tuple], float, object]:
    """Records of a key's days after ``last`` from the weight ``held``, and both afterwards.

    A day that does not follow the one before it is an error, as is a target
    outside [0, 1]. A day without a target changes nothing but the date.
    """
    rows = []
    for day in days.sort_values("date").itertuples():
        if last is not None and day.date <= last:
            raise ValueError(f"{day.symbol} {day.strategy}: {day.date} comes after {last}")
        last = day.date
        goal, r = day.target, 0.0 if pd.isna(day.next_return) else day.next_return
        if pd.isna(goal):
            continue
        if not 0 <= goal <= 1:
            raise ValueError("a target weight lies outside 0 and 1")
        move = goal - held
        trade = abs(move) >= band or (goal == 0) != (held == 0)
        turnover = abs(move / (1 + cost * goal if move >= 0 else 1 - cost * goal)) if trade else 0.0
        weight = goal if trade else held
        rows.append((day.symbol, day.strategy, day.date, (1 - cost * turnover) * (1 + weight * r) - 1, weight, turnover, "day"))
        held = weight * (1 + r) / (1 + weight * r)
    return rows, held, last


class Rebalance(StatefulProcessor):
    """Held weight and last date of each symbol and strategy, forgotten when no day has come for ``idle_ms``."""

    def __init__(self, cost: float, band: float, idle_ms: int):
        self.cost, self.band, self.idle_ms = cost, band, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("position", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, last, _ = self.state.get() if self.state.exists() else (0.0, None, None)
        days = pd.concat(list(rows))
        out, held, last = step_days(days, held, last, self.cost, self.band)
        seen = days["arrived"].max()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(seen.timestamp() * 1000) + self.idle_ms)
        self.state.update((held, last, seen.to_pydatetime()))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, last, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(*key, last, None, held, None, "expired")], columns=_COLUMNS)

    def close(self) -> None:
        pass


def rebalance(days: DataFrame, *, cost: float, band: float, idle: str = "30 days", slack: str = "1 hour") -> DataFrame:
    """Daily records of each symbol and strategy, and a row ``expired`` when a key is forgotten.

    ``days``: a stream of symbol, strategy, date, next_return, target and
    ``arrived`` (timestamp of the delivery). The watermark follows arrivals,
    not dates, so a day that is older than what its key has seen is not
    dropped in silence: it is an error, and nothing of its batch gets out.
    (Times of arrival may go back by ``slack`` at most; the engine drops what
    arrives with an older one.) A key
    without a delivery for ``idle`` loses its state, so delisted symbols do
    not pile up; if it comes back, it starts from cash. Uses the state store
    of use_rocksdb.
    """
    idle_ms = days.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {idle})").alias("ms")).first()["ms"]
    marked = days.select("symbol", "strategy", "date", "next_return", "target", "arrived").withWatermark("arrived", slack)
    return marked.groupBy("symbol", "strategy").transformWithStateInPandas(Rebalance(cost, band, idle_ms), REBALANCED, "append", "eventTime")


DAYS = "symbol string, strategy string, date date, next_return double, target double, arrived timestamp"


def run(spark: SparkSession, inbox: str, out: str, checkpoint: str, *, cost: float, band: float, idle: str = "30 days", partitions: int | None = None) -> None:
    """Take in the deliveries (DAYS) that have come to ``inbox``; records go to ``out`` by batch, so that a batch that runs again replaces its own. ``partitions``: of the state, chosen by the first run."""
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    with state_partitions(spark, partitions):
        moved = rebalance(spark.readStream.schema(DAYS).parquet(inbox), cost=cost, band=band, idle=idle)
        moved.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def records(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REBALANCED).parquet(out).drop("batch")
