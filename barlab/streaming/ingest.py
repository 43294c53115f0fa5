"""Deliveries of ticks and quotes as incremental jobs, from files to stored bars.

Two streams in a row, each with a checkpoint of its own, run whenever new
deliveries may have come:

1. intake: every tick goes to one of three tables, by batch: on time, late
   (its time lies at or before the watermark that held when its batch began),
   or rejected (a field is missing). Nothing is lost silently.
2. bars: ticks on time, without repeats within the watermark, become bars of
   closed windows; a batch of bars is validated as a whole and stored, or set
   aside as a whole.

Quotes have a stream of their own, so that their failure never touches bars.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from barlab.operators import quality
from barlab.streaming import bars as st

TICK = "event_id long, ts timestamp, symbol string, price double, volume double"
QUOTE = "symbol string, price double, received_at long"


@dataclass(frozen=True)
class Store:
    """Folders of one job: what came in, what became of it, and how far its streams are."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("inbox", "quote_inbox", "ticks", "late", "rejected", "progress", "bars", "refused", "quotes"):
            return f"{self.root}/{name}"
        raise AttributeError(name)

    def checkpoint(self, stream: str) -> str:
        return f"{self.root}/checkpoints/{stream}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written by batches, with its ``batch``; without rows where no batch has been written."""
    full = f"{schema}, batch int"
    return spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)


@contextmanager
def state_partitions(spark: SparkSession, number: int | None) -> Iterator[None]:
    """Streams that start for the first time in here keep their state in so many parts, for as long as their checkpoint lives; None: as many as the session's shuffles have."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        if number is not None:
            spark.conf.set(name, str(number))
        yield
    finally:
        spark.conf.set(name, before)


def deliver(rows: DataFrame, inbox: str) -> None:
    """New files for a stream."""
    rows.write.mode("append").parquet(inbox)


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _put(df: DataFrame, path: str, batch: int) -> None:
    """A batch's part of a table; a repeated batch replaces its own."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def missing_fields(columns: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"no_{c}")) for c in columns]))


def split_arrivals(store: Store, delay: str):
    """The sink of the intake stream.

    The watermark of a batch is the latest time among the complete ticks of
    all batches before it, in whole milliseconds as the engine counts, less
    ``delay``. It depends on what was delivered only, so a batch that runs
    again splits in the same way.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = stored(spark, store.progress, "high timestamp").where(F.col("batch") < number).agg(F.max("high")).first()[0]
        mark = F.lit(before) - F.expr(f"INTERVAL {delay}")
        checked = batch.withColumn("reasons", missing_fields(["event_id", "ts", "symbol", "price", "volume"])).persist()
        try:
            whole = checked.where(F.size("reasons") == 0).drop("reasons")
            late = F.lit(False) if before is None else F.col("ts") <= mark
            _put(checked.where(F.size("reasons") > 0), store.rejected, number)
            _put(whole.where(late).withColumn("watermark", F.lit(None).cast("timestamp") if before is None else mark), store.late, number)
            _put(whole.where(~late), store.ticks, number)
            _put(whole.agg(F.date_trunc("millisecond", F.max("ts")).alias("high")), store.progress, number)
        finally:
            checked.unpersist()

    return sink


def store_or_set_aside(store: Store):
    """The sink of the bars stream: a batch's bars are all stored, or all set aside with what is wrong about each.

    A batch with an invalid bar, with two of the same window, or with one that
    an earlier batch has stored is set aside; what is stored stays as it is.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        there = stored(spark, store.bars, BAR).where(F.col("batch") != number).select("symbol", "start", F.lit(True).alias("there"))
        twice = batch.groupBy("symbol", "start").agg((F.count(F.lit(1)) > 1).alias("twice"))
        more = F.array_compact(F.array(F.when(F.col("twice"), F.lit("repeated")), F.when(F.col("there"), F.lit("stored_before"))))
        judged = quality.violations(batch.withColumn("date", F.to_date("start"))).join(twice, ["symbol", "start"]).join(there, ["symbol", "start"], "left")
        judged = judged.select(*batch.columns, F.concat("reasons", more).alias("reasons")).persist()
        try:
            if judged.where(F.size("reasons") > 0).isEmpty():
                _put(batch, store.bars, number)
            else:
                _put(judged, store.refused, number)
        finally:
            judged.unpersist()

    return sink


BAR = "symbol string, start timestamp, open double, high double, low double, close double, volume double"


def ingest(spark: SparkSession, store: Store, *, delay: str = "1 hour", width: str = "1 day", partitions: int | None = None) -> None:
    """Take in all deliveries that have come since the last run, and store the bars that they close.

    Ticks (TICK) come as files in ``store.inbox``, the files of one run in one
    batch. A tick is a repeat of another with its symbol and event_id within
    the watermark. The last, open window of a symbol is never stored.
    ``partitions``: of the state, chosen by the first run.
    """
    with state_partitions(spark, partitions):
        arrivals = spark.readStream.schema(TICK).parquet(store.inbox)
        _run(arrivals.writeStream.foreachBatch(split_arrivals(store, delay)), store.checkpoint("intake"))
        on_time = spark.readStream.schema(TICK).parquet(store.ticks)
        closed = st.daily_bars(st.dedup_ticks(on_time.select("event_id", "ts", "symbol", "price", "volume"), keys=["symbol", "event_id"], delay=delay), width=width, delay=None)
        _run(closed.writeStream.outputMode("append").foreachBatch(store_or_set_aside(store)), store.checkpoint("bars"))


def ingest_quotes(spark: SparkSession, store: Store, *, partitions: int | None = None) -> None:
    """Take in the quotes (QUOTE) that have come: the newest of each symbol that has a new one, by batch."""
    with state_partitions(spark, partitions):
        newest = st.latest_quotes(spark.readStream.schema(QUOTE).parquet(store.quote_inbox))
        _run(newest.writeStream.outputMode("update").foreachBatch(lambda batch, number: _put(batch, store.quotes, number)), store.checkpoint("quotes"))


def bars_with_quotes(spark: SparkSession, store: Store) -> DataFrame:
    """Stored bars with each symbol's newest quote, null where there is none, as when no quote has ever come."""
    quotes = stored(spark, store.quotes, "symbol string, quote double, received_at long").select("symbol", F.col("quote").alias("price"), "received_at")
    return st.with_quotes(stored(spark, store.bars, BAR), quotes)


def by_kind(spark: SparkSession, store: Store) -> DataFrame:
    """What became of everything: stored and refused bars, late and rejected ticks; kind, batch, symbol, at, and a bar's values or a tick's as open and volume."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    reasons = F.concat_ws("|", "reasons").alias("reasons")
    values = ("open", "high", "low", "close", "volume")
    tick = [F.col("symbol"), F.col("ts").alias("at"), "event_id", F.col("price").alias("open"), *none("double", "high", "low", "close"), "volume"]
    parts = [
        bars_with_quotes(spark, store).select(F.lit("stored").alias("kind"), "batch", "symbol", F.col("start").alias("at"), *none("long", "event_id"), *values, "quote", F.lit("").alias("reasons")),
        stored(spark, store.refused, f"{BAR}, reasons array<string>").select(F.lit("refused").alias("kind"), "batch", "symbol", F.col("start").alias("at"), *none("long", "event_id"), *values, *none("double", "quote"), reasons),
        stored(spark, store.late, f"{TICK}, watermark timestamp").select(F.lit("late").alias("kind"), "batch", *tick, *none("double", "quote"), F.lit("").alias("reasons")),
        stored(spark, store.rejected, f"{TICK}, reasons array<string>").select(F.lit("rejected").alias("kind"), "batch", *tick, *none("double", "quote"), reasons),
    ]
    return reduce(DataFrame.unionByName, parts)
