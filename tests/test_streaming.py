from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from barlab.operators.backtest import run_weights
from barlab.schemas import BAR
from barlab.streaming import bars as st, ingest as ig, rebalance as rb


def ticks(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, symbol string, price double, volume double").coalesce(1).write.mode("append").parquet(path)


def run(query_df, spark, name, mode="append", checkpoint=None):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_only_closed_days_and_no_repeats(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    ticks(spark, src, [(1, t0, "X", 5.0, 1.0), (1, t0, "X", 5.0, 1.0), (2, t0 + timedelta(hours=9), "X", 7.0, 1.0), (3, t0 + timedelta(days=1, hours=3), "X", 6.0, 1.0)])
    stream = spark.readStream.schema("event_id long, ts timestamp, symbol string, price double, volume double").parquet(src)
    got = run(st.daily_bars(st.dedup_ticks(stream, keys=["symbol", "event_id"]), delay=None), spark, "closed_days", checkpoint=str(tmp_path / "c")).collect()
    assert [(r["open"], r["close"], r["volume"]) for r in got] == [(5.0, 7.0, 2.0)]


def test_quotes_stay_beside_the_bars(spark):
    bars = spark.createDataFrame([("X", date(2000, 1, 1), 1.0), ("Y", date(2000, 1, 1), 2.0)], "symbol string, date date, close double")
    quotes = spark.createDataFrame([("X", 3.0, 1), ("X", 4.0, 2)], "symbol string, price double, received_at long")
    assert {r["symbol"]: r["quote"] for r in st.with_quotes(bars, quotes).collect()} == {"X": 4.0, "Y": None}


def test_an_invalid_batch_changes_nothing(spark, tmp_path):
    sink = st.swap_on_complete(str(tmp_path / "bars"))
    row = lambda d, high: ("X", date(2000, 1, d), 10.0, high, 9.0, 11.0, 1.0)
    sink(spark.createDataFrame([row(1, 12.0)], BAR), 0)
    with pytest.raises(ValueError):
        sink(spark.createDataFrame([row(2, 12.0), row(3, 1.0)], BAR), 1)
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 1
    sink(spark.createDataFrame([row(1, 12.0)], BAR), 0)
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 1


DELIVERED = "symbol string, strategy string, date date, next_return double, target double, arrived timestamp"


def deliver(spark, path, rows, number):
    arrived = datetime(2024, 1, 1) + timedelta(days=number)
    spark.createDataFrame([(*r, arrived) for r in rows], DELIVERED).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    rb.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def test_stateful_rebalance_equals_the_batch(spark, rocksdb, tmp_path):
    rng = np.random.default_rng(2)
    r, goal = rng.normal(0, 0.03, (2, 60)), rng.choice([0, 0.5, 0.53, 1.0], (2, 60))
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "c"))
    first = date(2000, 1, 1)
    for number, part in enumerate((slice(0, 25), slice(25, 26), slice(26, 60))):
        deliver(spark, src, [(s, "m", first + timedelta(int(i)), float(r[k, i]), None if i == 30 else float(goal[k, i])) for k, s in enumerate("XY") for i in rng.permutation(range(60)[part])], number)
        rb.run(spark, src, out, ck, cost=0.0015, band=0.05)
    got = rb.records(spark, out).orderBy("symbol", "date").toPandas()
    active = np.ones((60, 1), bool)
    active[30] = False
    for k, s in enumerate("XY"):
        net, weight, *_ = run_weights(r[k], goal[k][:, None], active, np.array([0.0015]), 0.05)
        own = got[got["symbol"] == s]
        np.testing.assert_allclose(own["return"], net[active[:, 0], 0], atol=1e-14)
        np.testing.assert_allclose(own["weight"], weight[active[:, 0], 0], atol=1e-14)
    stored = rb.records(spark, out).count()
    # a day before one that was seen is an error, and nothing of its batch is stored
    deliver(spark, src, [("X", "m", first + timedelta(days=59), 0.0, 1.0), ("Y", "m", first + timedelta(days=99), 0.0, 1.0)], 3)
    with pytest.raises(StreamingQueryException, match="comes after"):
        rb.run(spark, src, out, ck, cost=0.0015, band=0.05)
    assert rb.records(spark, out).count() == stored


def test_an_idle_key_is_forgotten_and_starts_from_cash(spark, rocksdb, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "c"))
    day = lambda n: date(2000, 1, 1) + timedelta(n)
    deliver(spark, src, [("X", "m", day(0), 0.1, 1.0), ("Y", "m", day(0), 0.0, 0.5)], 0)
    rb.run(spark, src, out, ck, cost=0.0, band=0.05, idle="10 days")
    deliver(spark, src, [("Y", "m", day(1), 0.0, 0.5)], 5)
    rb.run(spark, src, out, ck, cost=0.0, band=0.05, idle="10 days")
    deliver(spark, src, [("Y", "m", day(2), 0.0, 0.5)], 14)
    rb.run(spark, src, out, ck, cost=0.0, band=0.05, idle="10 days")
    got = rb.records(spark, out)
    assert [(r.symbol, r.date, r.weight) for r in got.where("event = 'expired'").collect()] == [("X", day(0), 1.0)]
    deliver(spark, src, [("X", "m", day(3), 0.0, 1.0)], 15)
    rb.run(spark, src, out, ck, cost=0.0, band=0.05, idle="10 days")
    again = rb.records(spark, out).where(f"symbol = 'X' AND date = '{day(3)}'").first()
    assert again.turnover == 1.0
    assert rb.records(spark, out).where("symbol = 'Y' AND event = 'day'").agg({"turnover": "sum"}).first()[0] == 0.5


# ---- deliveries


def tick(n, at, symbol="X", price=1.0):
    return (n, at, symbol, price, 1.0)


def test_deliveries_lose_nothing(spark, tmp_path):
    store = ig.Store(str(tmp_path / "s"))
    t = lambda d, h=0, m=0: datetime(2024, 1, d, h, m)
    put = lambda *rows: ig.deliver(spark.createDataFrame(list(rows), ig.TICK), store.inbox)
    put(tick(1, t(1), price=5.0), tick(2, t(1, 9), price=7.0), tick(2, t(1, 9), price=7.0), tick(3, t(2, 3), price=6.0), tick(4, None), tick(5, t(2, 1), price=None))
    ig.ingest(spark, store)
    # late: before 2 o'clock of the second; a repeat and a new tick on time
    put(tick(6, t(1, 23)), tick(3, t(2, 3), price=6.0), tick(7, t(2, 2, 30), price=4.0), tick(8, t(3, 5), price=8.0), tick(9, t(2, 2)))
    ig.ingest(spark, store)
    ig.ingest(spark, store)  # nothing has come
    got = ig.by_kind(spark, store).collect()
    of = lambda kind: sorted((r.event_id if r.event_id is not None else r.at, r.open, r.close, r.volume) for r in got if r.kind == kind)
    assert of("stored") == [(t(1), 5.0, 7.0, 2.0), (t(2), 4.0, 6.0, 2.0)]
    assert [x[0] for x in of("late")] == [6, 9] and [(r.event_id, r.reasons) for r in got if r.kind == "rejected"] == [(4, "no_ts"), (5, "no_price")]
    assert of("refused") == []


def test_a_bad_batch_is_set_aside_whole(spark, tmp_path):
    store = ig.Store(str(tmp_path / "s"))
    t = lambda d: datetime(2024, 1, d, 12)
    put = lambda *rows: ig.deliver(spark.createDataFrame(list(rows), ig.TICK), store.inbox)
    put(tick(1, t(1)), tick(2, t(1), "Y"), tick(3, t(3)))
    ig.ingest(spark, store)
    put(tick(4, t(4), price=-2.0), tick(5, t(4), "Y"), tick(6, t(6)))
    ig.ingest(spark, store)
    put(tick(7, t(8)), tick(8, t(8), "Y"))
    ig.ingest(spark, store)
    got = ig.by_kind(spark, store).collect()
    # the third and fourth closed with the second delivery, one bar of which is wrong
    assert sorted((r.symbol, r.at.day) for r in got if r.kind == "stored") == [("X", 1), ("X", 6), ("Y", 1)]
    assert sorted((r.symbol, r.at.day, r.reasons) for r in got if r.kind == "refused") == [("X", 3, ""), ("X", 4, "price_not_positive"), ("Y", 4, "")]


def test_the_sinks_run_again_without_change(spark, tmp_path):
    store = ig.Store(str(tmp_path / "s"))
    split, keep = ig.split_arrivals(store, "1 hour"), ig.store_or_set_aside(store)
    a = spark.createDataFrame([tick(1, datetime(2024, 1, 2))], ig.TICK)
    b = spark.createDataFrame([tick(2, datetime(2024, 1, 1)), tick(3, datetime(2024, 1, 3))], ig.TICK)
    for batch, number in ((a, 0), (b, 1), (a, 0), (b, 1)):
        split(batch, number)
    assert [r.event_id for r in ig.stored(spark, store.late, ig.TICK).collect()] == [2]
    bar = spark.createDataFrame([("X", datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], ig.BAR)
    for number in (0, 0, 1):
        keep(bar, number)
    assert ig.stored(spark, store.bars, ig.BAR).count() == 1
    assert [r.reasons for r in ig.stored(spark, store.refused, f"{ig.BAR}, reasons array<string>").collect()] == [["stored_before"]]


def test_quotes_in_deliveries(spark, tmp_path):
    store = ig.Store(str(tmp_path / "s"))
    assert ig.bars_with_quotes(spark, store).collect() == []
    ig.store_or_set_aside(store)(spark.createDataFrame([("X", datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("Y", datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], ig.BAR), 0)
    for rows in ([("X", 3.0, 1), ("X", 5.0, 7)], [("X", 4.0, 3), ("Z", 1.0, 9)]):
        ig.deliver(spark.createDataFrame(rows, ig.QUOTE), store.quote_inbox)
        ig.ingest_quotes(spark, store)
    assert {r.symbol: r.quote for r in ig.bars_with_quotes(spark, store).collect()} == {"X": 5.0, "Y": None}
