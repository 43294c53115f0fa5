"""Queries that run streams over deliveries of the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.functions.storage import checkpointed, ensure_checkpoint_dir
from barlab.jobs.panel import index_bars, table
from barlab.jobs.registry import HOLDOUT, P, SIM, query, r6
from barlab.operators import features as ft, labels as lb
from barlab.schemas import STRATEGIES
from barlab.streaming import ingest as st, rebalance as rb


#: Parts of the streams' state: the given tables have a few symbols.
PARTS = 4


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# ---- T1 to T5: events as ticks, in deliveries of eight days

CUTS = ["2024-01-09", "2024-01-17", "2024-01-25"]
BAD = 3
_NUMBER = " + ".join(f"CAST(ts >= TIMESTAMP '{c}' AS INT)" for c in CUTS)


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with the number of their delivery: repeats in the same and in the next one, ticks that come one delivery late, ticks without a price, and a price below 0 in one delivery."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    number, at = F.expr(_NUMBER), F.col("event_id")
    wrong = F.when(at % 90 == 7, F.lit(None)).when((number == BAD) & (at % 300 == 5), -F.col("price") - 1).otherwise(F.col("price"))
    told = e.select("event_id", "ts", "symbol", wrong.alias("price"), "volume", (number + (at % 40 == 3).cast("int")).alias("delivery"))
    again = told.where(at % 50 == 0).unionByName(told.where(at % 50 == 1).withColumn("delivery", F.col("delivery") + 1))
    return checkpointed(told.unionByName(again))


_STREAM = f"""WITH e AS (SELECT event_id, ts, event_type AS symbol, value, {_NUMBER} AS k FROM events),
told AS (SELECT event_id, ts, symbol, CASE WHEN event_id % 90 = 7 THEN NULL WHEN k = {BAD} AND event_id % 300 = 5 THEN -value - 1 ELSE value END AS price, k + CAST(event_id % 40 = 3 AS INT) AS delivery FROM e),
del AS (SELECT * FROM told UNION ALL SELECT * FROM told WHERE event_id % 50 = 0 UNION ALL SELECT * REPLACE (delivery + 1 AS delivery) FROM told WHERE event_id % 50 = 1),
high AS (SELECT delivery, date_trunc('milliseconds', max(ts)) AS h FROM del WHERE price IS NOT NULL GROUP BY 1),
nums AS (SELECT DISTINCT delivery FROM del), mark AS (SELECT n.delivery, max(h) - INTERVAL 1 HOUR AS before FROM nums n LEFT JOIN high ON high.delivery < n.delivery GROUP BY 1), upto AS (SELECT n.delivery, max(h) - INTERVAL 1 HOUR AS after FROM nums n LEFT JOIN high ON high.delivery <= n.delivery GROUP BY 1),
seen AS (SELECT d.*, before, price IS NOT NULL AND before IS NOT NULL AND ts <= before AS late FROM del d JOIN mark USING (delivery)),
ticks AS (SELECT DISTINCT event_id, ts, symbol, price FROM seen WHERE price IS NOT NULL AND NOT late),
bars AS (SELECT symbol, date_trunc('day', ts) AS start, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM ticks GROUP BY 1, 2),
closed AS (SELECT b.*, (SELECT min(delivery) FROM upto WHERE after >= b.start + INTERVAL 1 DAY) AS delivery FROM bars b),
judged AS (SELECT *, bool_or(low <= 0) OVER (PARTITION BY delivery) AS bad FROM closed WHERE delivery IS NOT NULL),
quotes AS (SELECT event_type AS symbol, max_by(value, event_id) AS quote FROM events WHERE event_type <> 'view' GROUP BY 1)"""


@query("t1_t5_stream", f"""{_STREAM} SELECT 'stored' AS kind, delivery::BIGINT AS delivery, symbol, start AS at, NULL::BIGINT AS event_id, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(quote, 6) AS quote, '' AS reasons FROM judged LEFT JOIN quotes USING (symbol) WHERE NOT bad
UNION ALL SELECT 'refused', delivery::BIGINT, symbol, start, NULL, round(open, 6), round(high, 6), round(low, 6), round(close, 6), volume, NULL, CASE WHEN low <= 0 THEN 'price_not_positive' ELSE '' END FROM judged WHERE bad
UNION ALL SELECT 'late', delivery::BIGINT, symbol, ts, event_id, round(price, 6), NULL, NULL, NULL, 1.0, NULL, '' FROM seen WHERE late
UNION ALL SELECT 'rejected', delivery::BIGINT, symbol, ts, event_id, NULL, NULL, NULL, NULL, 1.0, NULL, 'no_price' FROM del WHERE price IS NULL""")
def t1_stream(spark, d):
    """All deliveries taken in one after the other by two streams, quotes by a third: stored and refused bars, late and rejected ticks, with the delivery that brought or closed them."""
    store = st.Store(scratch(spark, "ticks"))
    ticks = _deliveries(spark, d)
    opened = {}
    for number in range(len(CUTS) + 2):
        st.deliver(ticks.where(F.col("delivery") == number).drop("delivery"), store.inbox)
        before = {r[0] for kind in (store.bars, store.refused) for r in st.stored(spark, kind, st.BAR).select("batch").distinct().collect()}
        st.ingest(spark, store, partitions=PARTS)
        for kind in (store.bars, store.refused):
            opened |= {r[0]: number for r in st.stored(spark, kind, st.BAR).select("batch").distinct().collect() if r[0] not in before}
    quotes = table(spark, d, "events").where("event_type <> 'view'").select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.col("event_id").alias("received_at"), (F.expr(_NUMBER) >= 2).cast("int").alias("k"))
    for number in range(2):
        st.deliver(quotes.where(F.col("k") == number).drop("k"), store.quote_inbox)
        st.ingest_quotes(spark, store, partitions=PARTS)
    named = F.create_map(*[F.lit(x) for pair in opened.items() for x in pair]) if opened else F.create_map(F.lit(-1), F.lit(-1))
    delivery = F.when(F.col("kind").isin("stored", "refused"), F.element_at(named, F.col("batch"))).otherwise(F.col("batch"))
    return r6(st.by_kind(spark, store).withColumn("delivery", delivery.cast("long")).drop("batch")).withColumn("at", F.col("at").cast("timestamp_ntz"))


# ---- T6


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, strategy, date, next_return and target of the holdout, as b1_simulate has them."""
    w = ft.strategy_weights(ft.indicators(index_bars(spark, sf_dir), P)).withColumn("next_return", lb.next_open_return())
    lagged = lb.execution_lag(w, list(STRATEGIES), P.lag, start=P.holdout_start, stop=P.data_end)
    return lagged.unpivot(["symbol", "date", "next_return"], list(STRATEGIES), "strategy", "target")


@query("t6_rebalance_stream", f"""{SIM} SELECT symbol, strategy, date, round(ret, 6) AS "return", round(weight, 6) AS weight, round(turnover, 6) AS turnover, 'day' AS event FROM days""")
def t6(spark, d):
    """Half-years of decided days as deliveries to the keyed stream."""
    root = scratch(spark, "rebalance")
    rb.use_rocksdb(spark)
    days = checkpointed(_decided(spark, d).withColumn("part", (F.year("date") * 2 + F.floor(F.month("date") / 7)).cast("int")))
    for k, (part,) in enumerate(sorted(days.select("part").distinct().collect())):
        st.deliver(days.where(F.col("part") == part).drop("part").withColumn("arrived", F.lit(datetime(2024, 1, 1) + timedelta(k))), f"{root}/in")
        rb.run(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", cost=P.cost, band=P.band, partitions=PARTS)
    return r6(rb.records(spark, f"{root}/out"))
