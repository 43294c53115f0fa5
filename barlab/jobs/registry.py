"""All queries over the given tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.functions.storage import checkpointed, stored_once
from barlab.functions.windows import by_symbol
from barlab.jobs import sql as S
from barlab.jobs.panel import index_bars, latest_signals, table, tick_bars
from barlab.operators import backtest as bt, bootstrap as boot, calibration as cal, features as ft, labels as lb, models as md, performance as pf, quality as ql, scoring as sc, serving as sv, walkforward as wf
from barlab.schemas import STRATEGIES, Protocol
from barlab.sources import files as io
from barlab.streaming import bars as st

P = Protocol()
HOLDOUT = [s for s in bt.period_scenarios(P) if s.name == "holdout"]
SIM = S.simulated(HOLDOUT)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six digits, whole numbers to long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, 6) if kind == "double" else c.cast("long") if kind in ("integer", "short", "byte") else c).alias(f.name))
    return df.select(*out)


def sel(cols: str) -> str:
    """r6 in SQL: names with * are rounded, with # made BIGINT."""
    f = lambda c: f"round({c[1:]}, 6) AS {c[1:]}" if c[0] == "*" else f"CAST({c[1:]} AS BIGINT) AS {c[1:]}" if c[0] == "#" else c
    return ", ".join(f(c) for c in cols.split())


def bars(spark, d):
    """Bars as files, for queries that use them more than once: the ticks are read once."""
    return checkpointed(index_bars(spark, d))


def ind(spark, d, b=None):
    return ft.indicators(index_bars(spark, d) if b is None else b, P)


def matured(spark, d, horizon=7, b=None):
    got = lb.close_to_close(ind(spark, d, b), horizon)
    return lb.dataset(got.where("score IS NOT NULL"), [], start=P.research_start).select("symbol", "date", "label_end", "score", "target", "forward_return", "close")


MONTHS = (P.inner_start, date(2001, 11, 2))


def months(spark):
    return wf.folds(spark, *MONTHS)


def fold_probs(spark, rows, horizon=7):
    return wf.fold_probabilities(wf.expanding_counts(rows, months(spark), ["symbol"]), shrink=P.shrink * horizon, least=365)


def wide(spark, d, horizon=7, b=None):
    rows = checkpointed(matured(spark, d, horizon, b))
    return wf.predictions(rows, fold_probs(spark, rows, horizon), ["symbol"])


def preds(spark, d):
    got = wide(spark, d).withColumns({"historical_prior": F.col("prior"), "always_up": F.lit(1.0)})
    return wf.long_candidates(got, ["symbol"], ["historical_prior", "regime", "always_up"])


def outer(spark):
    return spark.createDataFrame([(date(y, 1, 1),) for y in P.reuse_years], "cutoff date")


def selection(spark, p):
    return wf.select_from_past(p, outer(spark), ["symbol"], ["historical_prior", "regime"])


def holdout(spark, d):
    return bt.backtest(index_bars(spark, d), HOLDOUT, P)


# ---- sources


@query("s9_bars_from_ticks", """SELECT l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, round(first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey), 6) AS open,
round(max(l_extendedprice), 6) AS high, round(min(l_extendedprice), 6) AS low, round(last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey), 6) AS close, round(sum(l_quantity), 6) AS volume FROM lineitem GROUP BY 1, 2""")
def s9(spark, d):
    return r6(tick_bars(spark, d))


def _klines(spark, d, keep=None):
    b = index_bars(spark, d)
    ms = F.unix_date("date").cast("long") * io.DAY_MS
    text = lambda c: F.round(c, 6).cast("string")
    k = F.array(ms.cast("string"), *[text(c) for c in ("open", "high", "low", "close", "volume")], (ms + io.DAY_MS - 1).cast("string"), F.lit("0"), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("0"))
    return b.select("symbol", F.year("date").alias("page"), F.to_json(F.array(k)).alias("value"), *([F.dayofmonth("date").alias(keep)] if keep else []))


@query("s1_read_klines", f"{S.BASE} SELECT {sel('symbol date *open *high *low *close *volume')}, 12::BIGINT AS raw_fields FROM bars")
def s1(spark, d):
    return r6(io.read_klines(_klines(spark, d)).drop("open_ms", "close_ms"))


@query("s4_merge_pages", f"{S.BASE} SELECT symbol, count(*) AS rows, min(date) AS first_bar, max(date) AS last_bar, round(sum(round(close, 6)), 3) AS closes FROM bars GROUP BY symbol")
def s4(spark, d):
    pages = _klines(spark, d)
    merged = io.joined_pages(io.read_klines(pages.where("page < 1998")), io.read_klines(pages.where("page >= 1998")))
    return merged.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.round(F.sum("close"), 3).alias("closes"))


@query("s1_rejects", f"{S.BASE} SELECT symbol, date, 'too_few_fields' AS reason FROM bars WHERE day(date) = 7 UNION ALL SELECT symbol, date, 'high_too_low' FROM bars WHERE day(date) = 9 UNION ALL SELECT symbol, NULL, 'bad_date' FROM bars WHERE day(date) = 8")
def s1r(spark, d):
    """Pages with planted faults: cut off fields on the 7th, no JSON on the 8th, a low high on the 9th of each month."""
    b = _klines(spark, d, keep="day")
    day = F.col("day")
    short, low = F.regexp_replace("value", r'(,"[^"]*"){6}\]\]$', "]]"), F.regexp_replace("value", r'^(\[\["[^"]*","[^"]*",")[^"]*', r"$10.000001")
    page = F.when(day == 7, short).when(day == 8, F.substring("value", 1, 9)).when(day == 9, low).otherwise(F.col("value"))
    bad = ql.rejects(io.read_klines(b.select("symbol", page.alias("value"))), fields=12)
    first = lambda x: F.when(F.array_contains("reasons", x), F.lit(x))
    return bad.select("symbol", "date", F.coalesce(first("bad_date"), first("too_few_fields"), first("high_too_low")).alias("reason"))


_BORDERS = """pg AS (SELECT symbol, 0::BIGINT AS page, date FROM bars WHERE date < DATE '1998-01-01' UNION ALL SELECT symbol, 1, date FROM bars WHERE date >= DATE '1997-12-22' AND date < DATE '2000-01-01' UNION ALL SELECT symbol, 2, date FROM bars WHERE date >= DATE '2000-01-06'),
sp AS (SELECT symbol, page, min(date) AS first, max(date) AS last FROM pg GROUP BY 1, 2),
gp AS (SELECT symbol, page, first - max(last) OVER (PARTITION BY symbol ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS days FROM sp)"""


@query("s4_page_borders", f"{S.BASE}, {_BORDERS} SELECT symbol, page, CASE WHEN days > 0 THEN 'gap' ELSE 'overlap' END AS problem, abs(days) AS days FROM gp WHERE days <> 0")
def s4b(spark, d):
    """All klines in three pages; the second starts ten days too early, the third five days too late."""
    b = checkpointed(io.read_klines(_klines(spark, d)))
    return r6(io.page_borders(b.where("date < '1998-01-01'"), b.where("date >= '1997-12-22' AND date < '2000-01-01'"), b.where("date >= '2000-01-06'")))


@query("s2_bars_from_strings", f"{S.BASE} SELECT {sel('symbol date *open *high *low *close *volume')} FROM bars")
def s2(spark, d):
    raw = r6(index_bars(spark, d)).select(F.col("volume").cast("string").alias("Volume"), F.col("symbol").alias("SYMBOL"), F.col("date").cast("string").alias("Date"), *[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c.upper()) for c in ("open", "high", "low", "close")])
    return io.bars_from_strings(raw)


@query("s3_read_quotes", "SELECT event_type AS symbol, round(value, 6) AS price, event_id AS received_at FROM events WHERE value > 0 AND event_id % 3 <> 0")
def s3(spark, d):
    e = table(spark, d, "events")
    price = F.when(F.col("event_id") % 3 == 0, F.lit("Infinity")).otherwise(F.col("value").cast("string"))
    made = e.select(F.to_json(F.struct(F.col("event_type").alias("symbol"), price.alias("price"))).alias("value"), F.col("event_id").alias("received_at"))
    return r6(io.read_quotes(made))


@query("s6_curve_bundle", f"{SIM} SELECT symbol, strategy, date + 1 AS valuation_date, round(equity, 6) AS equity, round(weight, 6) AS weight FROM days UNION ALL SELECT symbol, strategy, min(date), 1.0, 0.0 FROM days GROUP BY 1, 2")
def s6(spark, d):
    return r6(io.curve_bundle(holdout(spark, d)).drop("scenario"))


@query("s8_sample_bars", f"{S.BASE} SELECT {sel('symbol date *open *high *low *close *volume')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM bars) WHERE i <= 240")
def s8(spark, d):
    return r6(io.sample_bars(index_bars(spark, d)))


# ---- quality

_FLAG = "SELECT DISTINCT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem"


@query("d1_violations", """SELECT symbol, date, CASE WHEN h < greatest(o, c, l) THEN 'high_too_low' ELSE '' END || '|' || CASE WHEN l > least(o, c, h) THEN 'low_too_high' ELSE '' END AS reasons FROM (
SELECT l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o, last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS c,
round(avg(l_extendedprice), 2) AS h, min(l_extendedprice) AS l FROM lineitem GROUP BY 1, 2) WHERE h < greatest(o, c, l) OR l > least(o, c, h)""")
def d1(spark, d):
    mean = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.avg("l_extendedprice"), 2).alias("h"))
    wrong = tick_bars(spark, d).join(mean, ["symbol", "date"]).withColumn("high", F.col("h")).drop("h")
    has = lambda x: F.when(F.array_contains("reasons", x), x).otherwise("")
    return ql.rejects(wrong).select("symbol", "date", F.concat_ws("|", has("high_too_low"), has("low_too_high")).alias("reasons"))


_FAULTS = "CASE day(date) WHEN 1 THEN 'open_not_numeric' WHEN 2 THEN 'high_not_numeric' WHEN 3 THEN 'low_not_numeric' WHEN 4 THEN 'close_not_numeric' WHEN 5 THEN 'volume_not_numeric' WHEN 6 THEN 'price_not_positive' WHEN 7 THEN 'volume_negative' WHEN 8 THEN 'high_too_low|low_too_high' WHEN 9 THEN 'high_too_low|low_too_high' WHEN 10 THEN 'bad_date' END"


@query("d1_every_rule", f"{S.BASE} SELECT symbol, date AS day, concat_ws('|', {_FAULTS}, CASE WHEN date >= DATE '2001-10-01' AND day(date) <> 10 THEN 'not_closed' END) AS reasons FROM bars WHERE day(date) <= 10 OR date >= DATE '2001-10-01'")
def d1e(spark, d):
    """A fault of each kind planted on the first ten days of every month, and bars that are not closed yet."""
    n, none = F.dayofmonth("date"), F.lit(None)
    b = index_bars(spark, d).withColumn("day", F.col("date"))
    wrong = {
        "open": F.when(n == 1, none).otherwise(F.col("open")),
        "high": F.when(n == 2, none).when(n == 8, F.col("low") / 2).otherwise(F.col("high")),
        "low": F.when(n == 3, none).when(n == 6, 0.0).when(n == 9, F.col("high") * 2).otherwise(F.col("low")),
        "close": F.when(n == 4, none).otherwise(F.col("close")),
        "volume": F.when(n == 5, none).when(n == 7, -1.0).otherwise(F.col("volume")),
        "date": F.when(n != 10, F.col("date")),
    }
    return ql.rejects(b.withColumns(wrong), as_of=date(2001, 10, 1)).select("symbol", "day", F.concat_ws("|", "reasons").alias("reasons"))


@query("d2_duplicate_dates", "SELECT l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d2(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
    return ql.duplicate_dates(t)


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").cast("date").alias("date")).distinct()


_ORD = "WITH o AS (SELECT DISTINCT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders), g AS (SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS before FROM o)"


@query("d3_gap_report", f"{_ORD} SELECT symbol, before, date AS after, CAST(date - before - 1 AS BIGINT) AS missing FROM g WHERE date - before > 1")
def d3(spark, d):
    return r6(ql.gap_report(_orders(spark, d)))


@query("d3_missing_dates", f"{_ORD} SELECT symbol, CAST(unnest(generate_series(before + 1, date - 1, INTERVAL 1 DAY)) AS DATE) AS date FROM g WHERE date - before > 1")
def d3m(spark, d):
    return ql.missing_dates(_orders(spark, d))


@query("d4_contiguous_segments", f"{_ORD} SELECT symbol, date, CAST(sum(CAST(coalesce(date - before > 1, false) AS INT)) OVER (PARTITION BY symbol ORDER BY date) AS BIGINT) AS segment FROM g")
def d4(spark, d):
    return r6(ql.contiguous_segments(_orders(spark, d)))


@query("d5_closed_only", f"{S.BASE} SELECT {sel('symbol date *close')} FROM bars WHERE date <= DATE '2001-11-04' AND date + 1 <= DATE '2001-11-05'")
def d5(spark, d):
    ms = 1004918400000  # the midnight that ends 2001-11-04
    return r6(ql.closed_only(io.read_klines(_klines(spark, d)), ms).select("symbol", "date", "close"))


@query("d6_manifest", f"{S.BASE} SELECT symbol, count(*) AS rows, min(date) AS first_bar, max(date) AS last_bar, 'index' AS source, 'close and nothing else' AS altered, true AS same_again FROM bars GROUP BY symbol")
def d6(spark, d):
    """The manifest, whether a second build of the bars in another order has it too, and what one altered close does to the fingerprint."""
    b = bars(spark, d)
    frozen = ql.manifest(b, "index")
    again = ql.manifest_diff(frozen, ql.manifest(index_bars(spark, d).orderBy(F.desc("date")))).select("symbol", F.lit(False).alias("same"))
    last = b.groupBy("symbol").agg(F.max("date").alias("date"), F.lit(1.0).alias("more"))
    altered = b.join(last, ["symbol", "date"], "left").withColumn("close", F.col("close") + F.coalesce("more", F.lit(0.0))).drop("more")
    found = ql.manifest_diff(frozen, ql.manifest(altered)).select("symbol", F.when(F.concat_ws(",", "what") == "fingerprint", "close and nothing else").alias("altered"))
    return frozen.drop("fingerprint").join(found, "symbol", "left").join(again, "symbol", "left").withColumn("same_again", F.coalesce("same", F.lit(True))).drop("same")


@query("d7_coverage", f"{S.BASE} SELECT symbol, count(*) AS rows, max(date) AS last_bar, count(*) BETWEEN 201 AND 20000 AS size_ok, max(date) >= DATE '2000-01-01' AS reaches, CAST(DATE '2001-11-06' - max(date) AS BIGINT) AS stale_days, DATE '2001-11-06' > max(date) AS stale FROM bars GROUP BY symbol")
def d7(spark, d):
    return r6(ql.coverage(index_bars(spark, d), reach=P.holdout_start, yesterday=date(2001, 11, 6)))


@query("d9_dataset_diff", f"{S.BASE} SELECT symbol, date, 'close' AS what FROM bars WHERE day(date) = 13")
def d9(spark, d):
    b = index_bars(spark, d).select("symbol", "date", "close")
    other = b.withColumn("close", F.when(F.dayofmonth("date") == 13, F.col("close") + 1).otherwise(F.col("close")))
    return ql.dataset_diff(b, other, ["symbol", "date"], tolerance=1e-9).select("symbol", "date", F.concat_ws(",", "what").alias("what"))


# ---- features


@query("f1_f6_indicators", f"{S.BASE} SELECT {sel('symbol date *close *sma *momentum *vol #score *weight')} FROM ind")
def f1(spark, d):
    return r6(ind(spark, d).select("symbol", "date", "close", "sma", "momentum", "vol", "score", "weight"))


@query("f6_strategy_weights", f"{S.BASE} SELECT symbol, date, strategy, round(target, 6) AS target FROM (SELECT symbol, date, unnest(['trend_model', 'buy_hold', 'sma200', 'vol_hold']) AS strategy, unnest([CASE WHEN score = 2 THEN weight WHEN score IS NOT NULL THEN 0.0 END, CASE WHEN score IS NOT NULL THEN 1.0 END, CASE WHEN score IS NOT NULL THEN CAST(close > sma AS DOUBLE) END, CASE WHEN score IS NOT NULL THEN weight END]) AS target FROM ind)")
def f6(spark, d):
    return r6(ft.weights_long(ind(spark, d)))


_FEAT = f"""{S.BASE}, fe AS (SELECT symbol, date, close, open, high, low,
{', '.join(f"ln(close) - {S.lag('ln(close)', n)} AS return_{n}" for n in (1, 3, 7, 14, 30, 63, 126))},
{', '.join(f"close / {S.full(n, 'avg', 'close')} - 1 AS ma{n}" for n in (20, 50, 200))},
{', '.join(f"{S.full(n, 'stddev_samp', 'log_return')} * sqrt(365.0) AS vol{n}" for n in (30, 90))},
{S.full(14, 'avg', 'CASE WHEN change IS NOT NULL THEN greatest(change, 0.0) END')} AS up14, {S.full(14, 'avg', 'CASE WHEN change IS NOT NULL THEN greatest(-change, 0.0) END')} AS down14,
{S.full(14, 'avg', 'true_range')} / close AS atr14, (log_volume - {S.full(20, 'avg', 'log_volume')}) / nullif({S.full(20, 'stddev_samp', 'log_volume')}, 0) AS volume_z,
(high - low) / close AS "range", CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_position FROM daily),
fx AS (SELECT *, CASE WHEN up14 + down14 = 0 THEN 0.5 ELSE up14 / (up14 + down14) END AS rsi14, vol30 / vol90 AS vol_ratio FROM fe)"""


@query("f7_f13_features", f"{_FEAT} SELECT {sel('symbol date *return_1 *return_3 *return_7 *return_14 *return_30 *return_63 *return_126 *ma20 *ma50 *ma200 *vol30 *vol90 *rsi14 *vol_ratio *atr14 *volume_z')}, round(\"range\", 6) AS \"range\", round(close_position, 6) AS close_position FROM fx")
def f7(spark, d):
    return r6(ft.all_features(index_bars(spark, d)).select("symbol", "date", *ft.EXPANDED))


_SQUARES = ", ".join(f"round({c} * {c}, 6) AS {c}_sq" for c in "return_7 return_30 return_63 ma50 ma200 vol30 rsi14 vol_ratio".split())


@query("f14_interactions", f"{_FEAT} SELECT symbol, date, round(ma200 * return_63, 6) AS ma200_return63, round((rsi14 - 0.5) * ma200, 6) AS rsi_ma200, round(return_30 * vol30, 6) AS return30_vol30, {_SQUARES} FROM fx")
def f14(spark, d):
    return r6(ft.all_features(index_bars(spark, d)).select("symbol", "date", *ft.PRODUCTS, *ft.SQUARES))


_SETS = """(VALUES ('basic', ['return_7', 'return_30', 'return_63', 'ma50', 'ma200', 'vol30', 'rsi14', 'vol_ratio']),
('expanded', ['return_7', 'return_30', 'return_63', 'ma50', 'ma200', 'vol30', 'rsi14', 'vol_ratio', 'return_1', 'return_3', 'return_14', 'return_126', 'ma20', 'vol90', 'atr14', 'volume_z', 'range', 'close_position']),
('interactions', ['return_7', 'return_30', 'return_63', 'ma50', 'ma200', 'vol30', 'rsi14', 'vol_ratio', 'return_7_sq', 'return_30_sq', 'return_63_sq', 'ma50_sq', 'ma200_sq', 'vol30_sq', 'rsi14_sq', 'vol_ratio_sq', 'ma200_return63', 'rsi_ma200', 'return30_vol30'])) s(kind, names)"""


@query("f15_feature_sets", f"""{_FEAT}, sq AS (SELECT *, ma200 * return_63 AS ma200_return63, (rsi14 - 0.5) * ma200 AS rsi_ma200, return_30 * vol30 AS return30_vol30, {_SQUARES.replace(', 6)', ')').replace('round(', '(')} FROM fx),
lg AS (UNPIVOT (SELECT * EXCLUDE (date, close, open, high, low, up14, down14) FROM sq) ON * EXCLUDE (symbol) INTO NAME feature VALUE x)
SELECT symbol, kind, feature, count(x) AS n, round(avg(x), 6) AS mean FROM (SELECT kind, unnest(names) AS feature FROM {_SETS}) JOIN lg USING (feature) GROUP BY 1, 2, 3""")
def f15(spark, d):
    """Each set's features with how many values they have and their mean."""
    every = list(dict.fromkeys([*ft.EXPANDED, *ft.INTERACTIONS]))
    means = ft.all_features(index_bars(spark, d)).groupBy("symbol").agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean")).alias(c) for c in every])
    sets = [F.struct(F.lit(k).alias("kind"), F.lit(c).alias("feature"), F.col(c).alias("x")) for k in ft.FEATURE_SETS for c in ft.feature_set(k)]
    return r6(means.select("symbol", F.explode(F.array(*sets)).alias("s")).select("symbol", "s.kind", "s.feature", "s.x.*"))


@query("f16_range_slice", f"{S.BASE} SELECT symbol, date, round(close, 6) AS close, round(sma, 6) AS sma, round(close / p - 1, 6) AS day_change FROM (SELECT *, {S.lag('close')} AS p, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM ind WHERE date <= DATE '2001-06-30') WHERE i <= 90")
def f16(spark, d):
    return r6(ft.range_slice(ft.day_change(index_bars(spark, d)), date(2001, 6, 30)).select("symbol", "date", "close", "sma", "day_change"))


@query("f17_latest_signal", f"{S.BASE} SELECT {sel('symbol date *close *sma *momentum *vol #score *weight')}, date + 2 AS earliest_execution FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM ind) WHERE i = 1")
def f17(spark, d):
    return r6(ft.latest_signal(ind(spark, d).select("symbol", "date", "close", "sma", "momentum", "vol", "score", "weight")))


# ---- labels and calibration


@query("l1_open_to_open", f"{S.BASE},{S.OTO(7)} SELECT {sel('symbol date *forward_return label_end #target')} FROM lab")
def l1(spark, d):
    return r6(lb.open_to_open(ind(spark, d), 7).select("symbol", "date", "forward_return", "label_end", "target"))


@query("l2_close_to_close", f"{S.BASE},{S.CTC(30)} SELECT {sel('symbol date *forward_return label_end #target')} FROM lab")
def l2(spark, d):
    return r6(lb.close_to_close(ind(spark, d), 30).select("symbol", "date", "forward_return", "label_end", "target"))


@query("l3_dataset", f"{S.BASE},{S.CTC(7)} SELECT {sel('symbol date *sma *vol *forward_return #target')} FROM lab WHERE sma IS NOT NULL AND vol IS NOT NULL AND forward_return IS NOT NULL AND date >= DATE '1996-01-01'")
def l3(spark, d):
    got = lb.dataset(lb.close_to_close(ind(spark, d), 7), ["sma", "vol"], start=P.research_start)
    return r6(got.select("symbol", "date", "sma", "vol", "forward_return", "target"))


@query("l4_l5_execution_lag", f"{SIM} SELECT symbol, date, strategy, round(target, 6) AS target, round(r, 6) AS next_return FROM tgt")
def l4(spark, d):
    w = ft.strategy_weights(ind(spark, d)).withColumn("next_return", lb.next_open_return())
    got = lb.execution_lag(w, list(STRATEGIES), P.lag, start=P.holdout_start, stop=P.data_end)
    return r6(got.unpivot(["symbol", "date", "next_return"], list(STRATEGIES), "strategy", "target"))


_CALH = lambda h: f"{S.BASE},{S.OTO(h)}, fit AS (SELECT * FROM lab WHERE score IS NOT NULL AND target IS NOT NULL AND date >= DATE '1996-01-01' AND label_end < DATE '1999-01-01'), tst AS (SELECT * FROM lab WHERE score IS NOT NULL AND target IS NOT NULL AND date >= DATE '2000-01-01')"
_CAL = _CALH(7)


def _split(spark, d, horizon=7, b=None):
    got = lb.open_to_open(ind(spark, d, b), horizon).where("score IS NOT NULL AND target IS NOT NULL")
    return cal.purged_split(got, start=P.research_start, calibration_end=P.calibration_end, evaluation_start=P.holdout_start)


def _fit(spark, d, horizon=7):
    return _split(spark, d, horizon).where("part = 'calibration'")


@query("a1_prior_probability", f"{_CAL} SELECT symbol, count(*) AS n, CAST(sum(target) AS BIGINT) AS ups, round((sum(target) + 1) / (count(*) + 2), 6) AS probability FROM fit GROUP BY symbol")
def a1(spark, d):
    return r6(cal.prior_probability(_fit(spark, d), ["symbol"]))


_GRID = "(SELECT DISTINCT symbol FROM fit) g CROSS JOIN (SELECT unnest([0, 1, 2]) AS score) s LEFT JOIN fit f ON f.symbol = g.symbol AND f.score = s.score"


@query("a2_regime_probability", f"{_CAL} SELECT g.symbol, s.score::BIGINT AS score, count(f.target) AS n, coalesce(sum(f.target), 0)::BIGINT AS ups, round((coalesce(sum(f.target), 0) + 1) / (count(f.target) + 2), 6) AS probability FROM {_GRID} GROUP BY 1, 2")
def a2(spark, d):
    return r6(cal.regime_probability(_fit(spark, d), ["symbol"]))


@query("a3_regime_shrunk", f"{_CAL}, pr AS (SELECT symbol, (sum(target) + 1) / (count(*) + 2) AS prior FROM fit GROUP BY 1) SELECT g.symbol, s.score::BIGINT AS score, count(f.target) AS n, coalesce(sum(f.target), 0)::BIGINT AS ups, round((coalesce(sum(f.target), 0) + 21 * max(prior)) / (count(f.target) + 21), 6) AS probability FROM {_GRID} JOIN pr ON pr.symbol = g.symbol GROUP BY 1, 2")
def a3(spark, d):
    return r6(cal.regime_probability(_fit(spark, d), ["symbol"], shrink=21))


@query("a4_return_quantiles", f"{_CAL} SELECT symbol, score::BIGINT AS score, round(quantile_cont(forward_return, 0.1), 6) AS q10, round(quantile_cont(forward_return, 0.5), 6) AS q50, round(quantile_cont(forward_return, 0.9), 6) AS q90 FROM fit GROUP BY 1, 2")
def a4(spark, d):
    return r6(cal.return_quantiles(_fit(spark, d), ["symbol"]))


@query("a5_observed_regimes", f"{_CAL} SELECT symbol, score::BIGINT AS score, count(*) AS n, round(avg(target), 6) AS up_share, round(avg(forward_return), 6) AS mean_return FROM tst GROUP BY 1, 2")
def a5(spark, d):
    return r6(cal.observed_regimes(_split(spark, d).where("part = 'test'"), ["symbol"]))


@query("a6_purged_split", f"{_CAL} SELECT symbol, 'calibration' AS part, count(*) AS n, max(label_end) AS last_label FROM fit GROUP BY 1 UNION ALL SELECT symbol, 'test', count(*), max(label_end) FROM tst GROUP BY 1")
def a6(spark, d):
    return _split(spark, d).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.max("label_end").alias("last_label"))


def _scored(spark, d, horizon=7, b=None):
    split = checkpointed(_split(spark, d, horizon, b).select("symbol", "date", "score", "target", "forward_return", "part"))
    fit, test = split.where("part = 'calibration'"), split.where("part = 'test'").drop("part")
    table_ = cal.regime_probability(fit, ["symbol"]).select("symbol", "score", "probability")
    prior = cal.prior_probability(fit, ["symbol"]).select("symbol", F.col("probability").alias("baseline"))
    return lb.score_probability(test, table_, ["symbol"]).join(prior, "symbol")


_SCOREDH = lambda h: f"{_CALH(h)}, tb AS (SELECT symbol, score, (sum(target) + 1) / (count(*) + 2) AS p FROM fit GROUP BY 1, 2), pr AS (SELECT symbol, (sum(target) + 1) / (count(*) + 2) AS baseline FROM fit GROUP BY 1), sco AS (SELECT t.symbol, t.date, t.score, t.target, t.forward_return, coalesce(p, 0.5) AS probability, baseline FROM tst t LEFT JOIN tb USING (symbol, score) JOIN pr USING (symbol))"
_SCORED = _SCOREDH(7)


@query("l6_score_probability", f"{_SCORED} SELECT {sel('symbol date #score #target *probability *baseline')} FROM sco")
def l6(spark, d):
    return r6(_scored(spark, d).drop("forward_return"))


@query("l8_folds", f"{S.FOLDS}, yc AS (SELECT DATE '1999-01-01' AS cutoff, DATE '2000-01-01' AS next_cutoff UNION ALL SELECT DATE '2000-01-01', DATE '2001-01-01') SELECT symbol, cutoff, count(*) FILTER (WHERE label_end < cutoff AND date >= cutoff - 730) AS train_rows, count(*) FILTER (WHERE date >= cutoff AND date < next_cutoff) AS test_rows, max(label_end) FILTER (WHERE label_end < cutoff AND date >= cutoff - 730) AS train_label_end FROM rows, yc GROUP BY 1, 2")
def l8(spark, d):
    f = wf.folds(spark, date(1999, 1, 1), date(2001, 1, 1), "year")
    return cal.fold_audit(lb.folds_of(checkpointed(matured(spark, d)), f, window_days=730), ["symbol"]).select("symbol", "cutoff", "train_rows", "test_rows", "train_label_end")


@query("a9_fold_audit", f"{S.FOLDS}, yc AS (SELECT DATE '1998-01-01' AS cutoff, DATE '1999-01-01' AS next_cutoff UNION ALL SELECT DATE '1999-01-01', DATE '2000-01-01') SELECT symbol, cutoff, count(*) FILTER (WHERE label_end < cutoff) AS train_rows, count(*) FILTER (WHERE date >= cutoff AND date < next_cutoff) AS test_rows, min(date) FILTER (WHERE label_end < cutoff) AS train_start, max(date) FILTER (WHERE label_end < cutoff) AS train_end, max(label_end) FILTER (WHERE label_end < cutoff) AS train_label_end, min(date) FILTER (WHERE date >= cutoff AND date < next_cutoff) AS test_start, max(date) FILTER (WHERE date >= cutoff AND date < next_cutoff) AS test_end FROM rows, yc GROUP BY 1, 2")
def a9(spark, d):
    f = wf.folds(spark, date(1998, 1, 1), date(2000, 1, 1), "year")
    return cal.fold_audit(lb.folds_of(checkpointed(matured(spark, d)), f), ["symbol"])


# ---- scores


@query("c1_c3_metrics", f"{_SCORED} SELECT symbol, {S.METRICS} FROM sco GROUP BY symbol")
def c1(spark, d):
    return r6(sc.metrics(_scored(spark, d), ["symbol"]))


@query("a7_metrics_by_year", f"{_SCORED} SELECT symbol, CAST(y AS BIGINT) AS year, {S.METRICS} FROM (SELECT *, year(date) AS y FROM sco) GROUP BY GROUPING SETS ((symbol), (symbol, y))")
def a7(spark, d):
    return r6(sc.metrics_by_year(_scored(spark, d), ["symbol"]))


@query("c2_brier_improvement", f"{_SCORED} SELECT symbol, round(avg((probability - target) ** 2), 6) AS brier, round(avg((baseline - target) ** 2), 6) AS base_brier, round(avg((baseline - target) ** 2) - avg((probability - target) ** 2), 6) AS improvement FROM sco GROUP BY symbol")
def c2(spark, d):
    return r6(sc.brier_improvement(_scored(spark, d), ["symbol"]))


@query("c4_auc", f"{_SCORED}, rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY probability) + (count(*) OVER (PARTITION BY symbol, probability) - 1) / 2 AS k FROM sco) SELECT symbol, round((sum(k) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * sum(1 - target)), 6) AS auc FROM rk GROUP BY symbol")
def c4(spark, d):
    return r6(sc.auc(_scored(spark, d), ["symbol"]))


@query("c5_reliability_bins", f"""{_SCORED}, e AS (SELECT i AS bin, i * CAST(0.1 AS DOUBLE) AS low, CASE WHEN i = 9 THEN CAST(1.0 AS DOUBLE) ELSE (i + 1) * CAST(0.1 AS DOUBLE) END AS high FROM range(10) t(i))
SELECT g.symbol, e.bin::BIGINT AS bin, round(low, 6) AS low, round(high, 6) AS high, count(target) AS n, round(avg(probability), 6) AS mean_probability, round(avg(target), 6) AS observed
FROM (SELECT DISTINCT symbol FROM sco) g CROSS JOIN e LEFT JOIN sco s ON s.symbol = g.symbol AND probability >= low AND (probability < high OR (e.bin = 9 AND probability <= 1)) GROUP BY 1, 2, 3, 4""")
def c5(spark, d):
    return r6(sc.reliability_bins(_scored(spark, d), ["symbol"]))


@query("c6_nonoverlap_offsets", f"{_SCORED}, nn AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) % 7 AS k FROM sco) SELECT symbol, CAST(k AS BIGINT) AS \"offset\", {S.METRICS} FROM nn GROUP BY 1, 2")
def c6(spark, d):
    return r6(sc.nonoverlap_offsets(_scored(spark, d), ["symbol"], 7))


@query("c7_confidence_subsets", f"""{_SCORED}, th AS (SELECT unnest([0.5, 0.55, 0.6, 0.65])::DOUBLE AS threshold)
SELECT a.symbol, a.threshold, count(target) AS total, count(target) FILTER (WHERE probability >= 0.5 AND target = 1) AS tp, round(avg(CAST((probability >= 0.5) = (target = 1) AS INT)), 6) AS accuracy, round(count(target) / any_value(a.total), 6) AS coverage
FROM (SELECT symbol, threshold, count(*) AS total FROM sco, th GROUP BY 1, 2) a LEFT JOIN sco s ON s.symbol = a.symbol AND greatest(probability, 1 - probability) >= a.threshold GROUP BY 1, 2""")
def c7(spark, d):
    return r6(sc.confidence_subsets(_scored(spark, d), ["symbol"]).select("symbol", "threshold", "total", "tp", "accuracy", "coverage"))


@query("c8_model_comparison", f"{S.FOLDS} SELECT p.symbol, p.candidate, count(*) AS total, round(avg(CAST((p.probability >= 0.5) = (p.target = 1) AS INT)), 6) AS accuracy, round(avg(CAST((b.probability >= 0.5) = (p.target = 1) AS INT)), 6) AS base_accuracy, round(avg((p.probability - p.target) ** 2), 6) AS brier, round(avg((b.probability - p.target) ** 2) - avg((p.probability - p.target) ** 2), 6) AS brier_improvement FROM preds p JOIN preds b ON b.symbol = p.symbol AND b.date = p.date AND b.candidate = 'historical_prior' GROUP BY 1, 2")
def c8(spark, d):
    return r6(sc.model_comparison(checkpointed(preds(spark, d)), ["symbol"], "historical_prior"))


# ---- backtest


@query("b1_simulate", f"{SIM} SELECT symbol, strategy, date AS execution_date, round(ret, 6) AS \"return\", round(weight, 6) AS weight, round(turnover, 6) AS turnover, round(fee, 6) AS cost_fraction, round(equity, 6) AS equity FROM days")
def b1(spark, d):
    return r6(holdout(spark, d).drop("scenario"))


@query("b3_b4_equity_drawdown", f"{SIM} SELECT symbol, strategy, date AS execution_date, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM eq")
def b3(spark, d):
    return r6(pf.equity_curve(holdout(spark, d)).select("symbol", "strategy", "execution_date", "equity", "drawdown"))


@query("b5_longest_underwater", f"{SIM}, {S.UNDER} SELECT symbol, strategy, longest_underwater_days FROM un")
def b5(spark, d):
    return r6(pf.longest_underwater(pf.equity_curve(holdout(spark, d))).drop("scenario"))


@query("b6_performance_stats", S.statistics(HOLDOUT, "symbol, strategy"))
def b6(spark, d):
    return r6(pf.performance_stats(holdout(spark, d)).drop("scenario"))


@query("b2_b7_period_metrics", S.statistics(bt.period_scenarios(P)))
def b7(spark, d):
    return r6(pf.performance_stats(bt.backtest(index_bars(spark, d), bt.period_scenarios(P), P)))


@query("b8_yearly_fresh_start", S.statistics(bt.yearly_scenarios(P, 1996, 2001)))
def b8(spark, d):
    return r6(pf.performance_stats(bt.backtest(index_bars(spark, d), bt.yearly_scenarios(P, 1996, 2001), P)))


@query("b9_b10_grid_and_stress", S.statistics(bt.sensitivity_scenarios(P) + bt.stress_scenarios(P)))
def b9(spark, d):
    return r6(pf.performance_stats(bt.backtest(index_bars(spark, d), bt.sensitivity_scenarios(P) + bt.stress_scenarios(P), P)))


@query("b11_rolling_return", f"{SIM}, ro AS (SELECT symbol, strategy, equity / CASE WHEN i = 365 THEN 1.0 ELSE lag(equity, 365) OVER (PARTITION BY symbol, strategy ORDER BY i) END - 1 AS x FROM days) SELECT symbol, strategy, count(*) AS windows, round(min(x), 6) AS lowest, round(avg(CAST(x > 0 AS INT)), 6) AS positive_share FROM ro WHERE x IS NOT NULL GROUP BY 1, 2")
def b11(spark, d):
    return r6(pf.rolling_return(holdout(spark, d), 365).drop("scenario"))


def _pair(h):
    """The two strategies' returns of the same days, from one pass over the daily records."""
    of = lambda s: F.max(F.when(F.col("strategy") == s, F.col("return"))).alias(s)
    both = h.where("strategy IN ('trend_model', 'vol_hold')").groupBy("symbol", F.col("execution_date").alias("date")).agg(of("trend_model"), of("vol_hold"))
    return both.where("trend_model IS NOT NULL AND vol_hold IS NOT NULL")


def _gain(spark, d, horizon, b=None):
    gain = (F.col("baseline") - F.col("target")) ** 2 - (F.col("probability") - F.col("target")) ** 2
    return _scored(spark, d, horizon, b).select("symbol", "date", F.lit(horizon).alias("horizon"), gain.alias("gain"))


RUNS = HOLDOUT + bt.sensitivity_scenarios(P) + bt.stress_scenarios(P)
_SHARPE = "sqrt(365.0) * (CASE WHEN stddev_samp(x) > 1e-9 THEN avg(x) / stddev_samp(x) ELSE 0 END - CASE WHEN stddev_samp(y) > 1e-9 THEN avg(y) / stddev_samp(y) ELSE 0 END) AS diff"
_U3 = f"""{SIM}, v AS (SELECT a.symbol, a.date, a.ret AS x, b.ret AS y FROM days a JOIN days b ON a.symbol = b.symbol AND a.i = b.i AND a.strategy = 'trend_model' AND b.strategy = 'vol_hold'),{S.bootstrap('v', 'symbol', _SHARPE, P.blocks, P.reps, P.seed)}
SELECT symbol, b AS block, count(*) AS reps, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high FROM resamples GROUP BY 1, 2"""
_U2 = lambda h: f"""{_SCOREDH(h)}, v AS (SELECT symbol, date, (baseline - target) ** 2 - (probability - target) ** 2 AS gain FROM sco),{S.bootstrap('v', 'symbol', 'avg(gain) AS mean', P.blocks, P.reps, P.seed)}
SELECT symbol, b AS block, count(*) AS reps, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM resamples GROUP BY 1, 2"""
_ONE = lambda scenario, c, strategy="trend_model": f"coalesce(max({c}) FILTER (WHERE scenario = '{scenario}' AND strategy = '{strategy}')"


@query("b12_acceptance_gates", f"""WITH st AS (SELECT * FROM ({S.statistics(RUNS)})), sh AS (SELECT symbol, bool_and(low > 0) AS sharpe_gain_certain FROM ({_U3}) GROUP BY 1), br AS (SELECT symbol, bool_and(low > 0) AS brier_gain_certain FROM (SELECT * FROM ({_U2(7)}) UNION ALL SELECT * FROM ({_U2(30)})) GROUP BY 1),
g AS (SELECT symbol, {_ONE('holdout', 'cagr')} > 0, false) AS cagr_positive, {_ONE('holdout', 'max_drawdown')} >= -0.35, false) AS drawdown_bounded,
{_ONE('holdout', 'sharpe')} > max(sharpe) FILTER (WHERE scenario = 'holdout' AND strategy = 'buy_hold'), false) AS sharpe_above_buy_hold, {_ONE('holdout', 'sharpe')} > max(sharpe) FILTER (WHERE scenario = 'holdout' AND strategy = 'vol_hold'), false) AS sharpe_above_vol_hold,
count(*) FILTER (WHERE strategy = 'trend_model' AND starts_with(scenario, 'sma') AND cagr > 0 AND max_drawdown >= -0.4) >= 7 AS neighbours_fine, {_ONE('cost_50', 'cagr')} > 0, false) AS cost_stress_positive, {_ONE('delay_3', 'cagr')} > 0, false) AS delay_stress_positive FROM st GROUP BY 1)
SELECT symbol, cagr_positive, drawdown_bounded, sharpe_above_buy_hold, sharpe_above_vol_hold, sharpe_gain_certain, brier_gain_certain, neighbours_fine, cost_stress_positive, delay_stress_positive,
cagr_positive AND drawdown_bounded AND sharpe_above_buy_hold AND sharpe_above_vol_hold AND sharpe_gain_certain AND brier_gain_certain AND neighbours_fine AND cost_stress_positive AND delay_stress_positive AS accepted FROM g JOIN sh USING (symbol) JOIN br USING (symbol)""")
def b12(spark, d):
    b = bars(spark, d)
    daily = checkpointed(bt.backtest(b, RUNS, P))
    sharpe = boot.sharpe_difference(_pair(daily.where("scenario = 'holdout'")), ["symbol"], "trend_model", "vol_hold", blocks=P.blocks, reps=P.reps, seed=P.seed)
    gains = _gain(spark, d, 7, b).unionByName(_gain(spark, d, 30, b))
    return pf.acceptance_gates(pf.performance_stats(daily), sharpe, boot.mean_intervals(gains, ["symbol", "horizon"], "gain", blocks=P.blocks, reps=P.reps, seed=P.seed))


# ---- bootstrap


@query("u1_circular_blocks", f"{_SCORED}, n AS (SELECT symbol, count(*) AS n FROM sco GROUP BY 1) SELECT symbol, CAST(rep AS BIGINT) AS rep, CAST(bn AS BIGINT) AS block_no, CAST('0x' || substr(md5('{P.seed}|' || rep || '|' || bn), 1, 8) AS BIGINT) % n AS start, CAST(least(30, n - bn * 30) AS BIGINT) AS size FROM n, (SELECT unnest(range({P.reps})) AS rep) r, (SELECT unnest(range(100)) AS bn) b WHERE bn < ceil(n / 30)")
def u1(spark, d):
    n = _scored(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return r6(boot.circular_blocks(n, ["symbol"], block=30, reps=P.reps, seed=P.seed).drop("n"))


@query("u2_mean_intervals", _U2(7))
def u2(spark, d):
    return r6(boot.mean_intervals(_gain(spark, d, 7), ["symbol"], "gain", blocks=P.blocks, reps=P.reps, seed=P.seed))


@query("u3_sharpe_difference", _U3)
def u3(spark, d):
    return r6(boot.sharpe_difference(_pair(holdout(spark, d)), ["symbol"], "trend_model", "vol_hold", blocks=P.blocks, reps=P.reps, seed=P.seed))


# ---- walk-forward


@query("w3_w4_expanding_counts", f"{S.FOLDS} SELECT {sel('symbol cutoff #n0 #ups0 #n1 #ups1 #n2 #ups2')} FROM cnt")
def w4(spark, d):
    return r6(wf.expanding_counts(matured(spark, d), months(spark), ["symbol"]))


@query("w4_window_counts", f"{S.FOLDS}, c2 AS (SELECT s.symbol, cutoff, count(*) FILTER (WHERE score = 0) AS n0, count(*) FILTER (WHERE score = 1) AS n1, count(*) FILTER (WHERE score = 2) AS n2, coalesce(sum(target), 0) AS ups FROM (SELECT DISTINCT symbol FROM rows) s CROSS JOIN cut LEFT JOIN rows r ON r.symbol = s.symbol AND r.label_end < cutoff AND r.date >= cutoff - 730 GROUP BY 1, 2) SELECT {sel('symbol cutoff #n0 #n1 #n2 #ups')} FROM c2")
def w4w(spark, d):
    got = wf.expanding_counts(matured(spark, d), months(spark), ["symbol"], window_days=730, span=7)
    return r6(got.select("symbol", "cutoff", "n0", "n1", "n2", (F.col("ups0") + F.col("ups1") + F.col("ups2")).alias("ups")))


@query("w4_fold_predictions", f"{S.FOLDS} SELECT {sel('symbol date cutoff *prior *regime #target')} FROM wide")
def w4p(spark, d):
    return r6(wide(spark, d).select("symbol", "date", "cutoff", "prior", "regime", "target"))


@query("w5_scale_params", f"{_FEAT}, tr AS (SELECT * FROM fx WHERE return_7 IS NOT NULL AND ma200 IS NOT NULL AND vol30 IS NOT NULL AND date < DATE '1999-01-01') SELECT symbol, round(avg(return_7), 6) AS c0, round(avg(ma200), 6) AS c1, round(avg(vol30), 6) AS c2, round(stddev_pop(return_7), 6) AS s0, round(stddev_pop(ma200), 6) AS s1, round(stddev_pop(vol30), 6) AS s2 FROM tr GROUP BY 1")
def w5(spark, d):
    rows = ft.all_features(index_bars(spark, d)).where("date < '1999-01-01'").dropna(subset=["return_7", "ma200", "vol30"])
    got = md.scale_params(rows, ["symbol"], ["return_7", "ma200", "vol30"])
    return r6(got.select("symbol", *[F.get("center", F.lit(i)).alias(f"c{i}") for i in range(3)], *[F.get("scale", F.lit(i)).alias(f"s{i}") for i in range(3)]))


def _model_rows(spark, d):
    fe = ft.all_features(index_bars(spark, d))
    return lb.dataset(lb.close_to_close(fe, 7), list(ft.EXPANDED), start=P.research_start)


_CUTS = [date(y, m, 1) for y in range(1998, 2002) for m in (1, 4, 7, 10)]


@query("w6_w7_logistic_folds")
def w6(spark, d):
    rows = checkpointed(_model_rows(spark, d))
    names = list(P.nested_features)
    fits = md.logistic_folds(rows, ["symbol"], names, _CUTS, penalty=0.1)
    at = rows.withColumn("cutoff", F.trunc("date", "quarter")).join(fits, ["symbol", "cutoff"])
    z = md.scaled(F.array(*names), F.col("center"), F.col("scale"))
    return r6(at.select("symbol", "date", "cutoff", "target", md.logistic_probability(z, F.col("coefficients")).alias("probability")))


_KNN = f"""{_FEAT}, kl AS (SELECT *, CAST({S.lead('close', 7)} / close - 1 > 0 AS INT) AS target, date + 7 AS label_end FROM fx), kr AS (SELECT symbol, date, label_end, target, return_7, ma200, vol30 FROM kl WHERE target IS NOT NULL AND date >= DATE '1996-01-01' AND {' AND '.join(f'"{c}" IS NOT NULL' for c in ft.EXPANDED)}),
cu AS (SELECT make_date(y, 1, 1) AS cutoff, make_date(y + 1, 1, 1) AS stop FROM (SELECT unnest([1998, 1999, 2000, 2001]) AS y)),
tr AS (SELECT kr.*, cutoff FROM kr JOIN cu ON label_end < cutoff), pa AS (SELECT symbol, cutoff, avg(return_7) AS c0, avg(ma200) AS c1, avg(vol30) AS c2, stddev_pop(return_7) AS s0, stddev_pop(ma200) AS s1, stddev_pop(vol30) AS s2 FROM tr GROUP BY 1, 2 HAVING count(*) >= 200),
z AS (SELECT kr.symbol, cutoff, date, label_end, target, greatest(-8, least(8, (return_7 - c0) / s0)) AS z0, greatest(-8, least(8, (ma200 - c1) / s1)) AS z1, greatest(-8, least(8, (vol30 - c2) / s2)) AS z2 FROM kr JOIN pa USING (symbol)),
nb AS (SELECT q.symbol, q.cutoff, q.date, t.target, row_number() OVER (PARTITION BY q.symbol, q.date ORDER BY (q.z0 - t.z0) ** 2 + (q.z1 - t.z1) ** 2 + (q.z2 - t.z2) ** 2, t.date) AS k FROM z q JOIN cu USING (cutoff) JOIN z t ON t.symbol = q.symbol AND t.cutoff = q.cutoff AND t.label_end < q.cutoff WHERE q.date >= q.cutoff AND q.date < stop)"""
_YEARS = [(date(y, 1, 1), date(y + 1, 1, 1)) for y in range(1998, 2002)]


@query("w8_knn", f"{_KNN} SELECT symbol, cutoff, date, round((sum(target) + 1) / 52, 6) AS probability FROM nb WHERE k <= 50 GROUP BY 1, 2, 3")
def w8(spark, d):
    """Neighbours of every year's rows among those known at its start."""
    return r6(md.knn_folds(_model_rows(spark, d), ["symbol"], ["return_7", "ma200", "vol30"], _YEARS, k=50))


@query("w11_leaderboard", f"{S.FOLDS}, yy AS (SELECT symbol, candidate, year(date) AS y, avg(CAST((probability >= 0.5) = (target = 1) AS INT)) AS a, sum(CAST((probability >= 0.5) = (target = 1) AS INT)) AS r, count(*) AS n, sum((probability - target) ** 2) AS l FROM preds GROUP BY 1, 2, 3), bo AS (SELECT symbol, candidate, sum(n)::BIGINT AS total, sum(r) / sum(n) AS accuracy, avg(a) AS mean_year_accuracy, min(a) AS worst_year_accuracy, sum(l) / sum(n) AS brier FROM yy GROUP BY 1, 2) SELECT {sel('symbol candidate total *accuracy *mean_year_accuracy *worst_year_accuracy *brier')}, row_number() OVER (PARTITION BY symbol ORDER BY mean_year_accuracy DESC, worst_year_accuracy DESC, brier, candidate) AS place FROM bo")
def w11(spark, d):
    return r6(wf.leaderboard(preds(spark, d), ["symbol"]))


@query("w13_select_from_past", f"{S.FOLDS} SELECT {sel('symbol cutoff selected *mean_annual_brier validation_rows')} FROM sel")
def w13(spark, d):
    return r6(selection(spark, preds(spark, d)))


@query("w14_nested_predictions", f"{S.FOLDS} SELECT p.symbol, date, candidate, round(probability, 6) AS probability, CAST(target AS BIGINT) AS target FROM preds p JOIN sel s ON s.symbol = p.symbol AND year(cutoff) = year(date) AND candidate = selected")
def w14(spark, d):
    p = checkpointed(preds(spark, d))
    return r6(wf.nested_predictions(p, selection(spark, p), ["symbol"]).select("symbol", "date", "candidate", "probability", "target"))


@query("w15_current_freeze", f"{S.FOLDS}, la AS (SELECT symbol, max_by(selected, cutoff) AS selected, max(cutoff) AS selection_date FROM sel GROUP BY 1) SELECT symbol, cutoff AS refit_date, CAST(cutoff + INTERVAL 1 MONTH AS DATE) AS valid_until, selected, selection_date, CAST(train_rows AS BIGINT) AS train_rows, round(prior, 6) AS probability, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cutoff DESC) AS i FROM prob2) JOIN la USING (symbol) WHERE i = 1")
def w15(spark, d):
    rows = checkpointed(matured(spark, d))
    probs = fold_probs(spark, rows)
    got = wf.predictions(rows, probs, ["symbol"]).withColumn("historical_prior", F.col("prior"))
    chosen = selection(spark, wf.long_candidates(got, ["symbol"], ["historical_prior", "regime"]))
    frozen = wf.current_freeze(probs, chosen, ["symbol"])
    return r6(frozen.select("*", *[F.element_at("regime_probabilities", F.lit(i)).alias(f"p{i}") for i in (0, 1, 2)]).drop("regime_probabilities"))


_FAM = "fm AS (SELECT unnest(['historical_prior', 'regime', 'always_up']) AS candidate, unnest(['baseline', 'regime', 'baseline']) AS family)"


@query("w12_family_winner", f"{S.FOLDS}, {_FAM}, yy AS (SELECT symbol, candidate, year(date) AS y, avg(CAST((probability >= 0.5) = (target = 1) AS INT)) AS a, count(*) AS n, sum((probability - target) ** 2) AS l FROM preds GROUP BY 1, 2, 3), bo AS (SELECT symbol, candidate, avg(a) AS ma, min(a) AS wa, sum(l) / sum(n) AS brier FROM yy GROUP BY 1, 2), pl AS (SELECT *, row_number() OVER (PARTITION BY symbol, family ORDER BY ma DESC, wa DESC, brier, candidate) AS k FROM bo JOIN fm USING (candidate)) SELECT symbol, family, candidate, round(ma, 6) AS mean_year_accuracy FROM pl WHERE k = 1")
def w12(spark, d):
    families = spark.createDataFrame([("historical_prior", "baseline"), ("regime", "regime"), ("always_up", "baseline")], "candidate string, family string")
    return r6(wf.family_winner(wf.leaderboard(preds(spark, d), ["symbol"]), families, ["symbol"]).select("symbol", "family", "candidate", "mean_year_accuracy"))


# ---- the candidate search: 40 candidates, annual folds, development and reuse

SEARCH_FOLDS = [(date(y, 1, 1), date(y + 1, 1, 1)) for y in (*P.dev_years, *P.reuse_years)]
EVERY = list(dict.fromkeys([*ft.EXPANDED, *ft.INTERACTIONS]))


def _search_rows(spark, d):
    got = lb.open_to_open(ft.all_features(index_bars(spark, d)), P.search_horizon, P.lag)
    return lb.dataset(got, EVERY, start=P.research_start).select("symbol", "date", "label_end", "target", "score", *EVERY)


def _in_phase(df):
    return df.withColumn("phase", wf.phase(P.dev_years, P.holdout_start))


def _search(spark, d):
    """symbol, date, label_end, target, candidate, probability and phase of all 40 candidates, fitted once and stored."""
    return stored_once(spark, f"{d}|search", lambda: _search_fits(spark, d))


def _search_fits(spark, d):
    rows = checkpointed(_search_rows(spark, d))
    years = wf.folds(spark, SEARCH_FOLDS[0][0], SEARCH_FOLDS[-1][1], "year")
    fitted = md.fitted_candidates(rows, ["symbol"], wf.candidate_specs(), ft.FEATURE_SETS, SEARCH_FOLDS)
    out = fitted.join(rows.select("symbol", "date", "label_end", "target"), ["symbol", "date"]).select("symbol", "date", "label_end", "target", "candidate", "probability")
    for window, tag in ((None, "expanding"), (730, "730d")):
        counts = wf.expanding_counts(rows, years, ["symbol"], window_days=window, span=P.lag + P.search_horizon)
        found = wf.predictions(rows, wf.fold_probabilities(counts, least=200), ["symbol"], every="year")
        named = found.withColumns({f"regime_{tag}": F.col("regime"), "historical_prior": F.col("prior"), "always_up": F.lit(1.0)})
        out = out.unionByName(wf.long_candidates(named, ["symbol"], [f"regime_{tag}", *([] if window else ["historical_prior", "always_up"])]))
    return _in_phase(out).where("phase IS NOT NULL")


def _families(spark):
    return wf.candidate_grid(spark).select(F.col("id").alias("candidate"), "family")


@query("w11_candidate_search")
def w11s(spark, d):
    """The development leaderboard of all 40 candidates."""
    board = wf.leaderboard(_search(spark, d).where("phase = 'development'"), ["symbol"])
    return r6(board.join(F.broadcast(_families(spark)), "candidate"))


@query("w12_reuse_years")
def w12r(spark, d):
    """Each family's development winner, the prior and always_up on the reused years."""
    found = checkpointed(_search(spark, d))
    best = wf.family_winner(wf.leaderboard(found.where("phase = 'development'"), ["symbol"]), _families(spark), ["symbol"]).select("symbol", "candidate")
    fixed = found.select("symbol").distinct().withColumn("candidate", F.explode(F.array(F.lit("historical_prior"), F.lit("always_up"))))
    return r6(sc.metrics(found.where("phase = 'reuse'").join(best.union(fixed).distinct(), ["symbol", "candidate"]), ["symbol", "candidate"]))


_ROWS30 = f"""{_FEAT}, k30 AS (SELECT *, {S.lead('open', 32)} / {S.lead('open', 2)} - 1 AS fr, date + 32 AS label_end FROM fx), sr AS (SELECT symbol, date, label_end FROM k30 WHERE fr IS NOT NULL AND date >= DATE '1996-01-01' AND {' AND '.join(f'"{c}" IS NOT NULL' for c in ft.EXPANDED)})"""


@query("w2_fold_audit", f"""{_ROWS30}, yc AS (SELECT y AS year, make_date(y, 1, 1) AS cutoff, CASE WHEN y < 2000 THEN 'development' ELSE 'reuse' END AS phase FROM (SELECT unnest([1998, 1999, 2000, 2001]) AS y))
SELECT symbol, phase, cutoff, count(*) FILTER (WHERE label_end < cutoff) AS train_rows, count(*) FILTER (WHERE year(date) = year AND (phase = 'reuse' OR label_end < DATE '2000-01-01')) AS test_rows, min(date) FILTER (WHERE label_end < cutoff) AS train_start, max(label_end) FILTER (WHERE label_end < cutoff) AS train_label_end, max(date) FILTER (WHERE year(date) = year AND (phase = 'reuse' OR label_end < DATE '2000-01-01')) AS test_end FROM sr, yc GROUP BY 1, 2, 3""")
def w2(spark, d):
    return _fold_audit(spark, _search_rows(spark, d))


def _fold_audit(spark, rows, years=None, dev_years=P.dev_years, dev_end=P.holdout_start):
    years = years if years is not None else wf.folds(spark, SEARCH_FOLDS[0][0], SEARCH_FOLDS[-1][1], "year")
    found = lb.folds_of(rows.select("symbol", "date", "label_end"), years)
    tested = found.where((F.col("role") == "train") | wf.phase(dev_years, dev_end).isNotNull())
    named = F.when(F.col("cutoff") < F.lit(dev_end), "development").otherwise("reuse")
    return cal.fold_audit(tested, ["symbol"]).select("symbol", named.alias("phase"), "cutoff", "train_rows", "test_rows", "train_start", "train_label_end", "test_end")


# ---- blends of the nested study (barlab.jobs.study) with a given fit


_FIXED = {"center": (0.0, 0.01, 0.02, 0.5), "scale": (0.1, 0.2, 0.25, 0.3), "coefficients": (0.1, 0.8, -0.4, 0.3, -0.2)}
_Z = [f"greatest(-8, least(8, ({c} - {m}) / {s}))" for c, m, s in zip(P.nested_features, _FIXED["center"], _FIXED["scale"])]
_DOT = " + ".join([str(_FIXED["coefficients"][0]), *[f"({b}) * {z}" for b, z in zip(_FIXED["coefficients"][1:], _Z)]])


@query("w9_blends_of_a_given_fit", f"""{S.FOLDS}, fe AS ({_FEAT} SELECT symbol, date, return_7, return_30, ma200, vol30 FROM fx), lo AS (SELECT w.symbol, w.date, prior, regime, 1 / (1 + exp(-({_DOT}))) AS logistic FROM wide w JOIN fe USING (symbol, date) WHERE return_7 IS NOT NULL AND return_30 IS NOT NULL AND ma200 IS NOT NULL AND vol30 IS NOT NULL)
SELECT symbol, date, round(prior, 6) AS historical_prior, round(regime, 6) AS regime_shrunk, round(0.5 * prior + 0.5 * logistic, 6) AS logistic_shrunk, round((regime + 0.5 * prior + 0.5 * logistic) / 2, 6) AS equal_blend, 1.0::DOUBLE AS always_up, 0.5::DOUBLE AS coin_flip FROM lo""")
def w9f(spark, d):
    """The blends where the logistic's coefficients are given, so that SQL can follow."""
    b = bars(spark, d)
    names = list(P.nested_features)
    fe = ft.all_features(b).select("symbol", "date", *names).dropna(subset=names)
    row = lambda k: F.array(*[F.lit(x) for x in _FIXED[k]])
    z = md.scaled(F.array(*names), row("center"), row("scale"))
    got = md.blends(wide(spark, d, 7, b).join(fe, ["symbol", "date"]).withColumn("logistic", md.logistic_probability(z, row("coefficients"))), P.prior_weight)
    return r6(got.select("symbol", "date", F.col("prior").alias("historical_prior"), F.col("regime").alias("regime_shrunk"), "logistic_shrunk", "equal_blend", "always_up", "coin_flip"))


# ---- evidence

_GAINH = lambda h: f"SELECT {h} AS horizon, * FROM ({S.folds(h)} SELECT symbol, date, year(date) AS y, (prior - target) ** 2 - (regime - target) ** 2 AS gain, CAST((regime >= 0.5) = (target = 1) AS INT) AS good, CAST((regime >= 0.5) = (target = 1) AS INT) - CAST((prior >= 0.5) = (target = 1) AS INT) AS more, (regime - target) ** 2 AS brier, (prior - target) ** 2 AS prior_brier FROM wide)"
_EVIDENCE = f"""WITH v AS ({_GAINH(7)} UNION ALL {_GAINH(30)}),{S.bootstrap('v', 'symbol, horizon', 'avg(gain) AS gain, avg(good) AS good, avg(more) AS more', P.blocks, P.reps, P.seed)},
iv AS (SELECT symbol, horizon, b, quantile_cont(gain, 0.025) AS low, quantile_cont(gain, 0.975) AS high, quantile_cont(good, 0.025) AS good_low, quantile_cont(more, 0.025) AS more_low FROM resamples GROUP BY 1, 2, 3), yr AS (SELECT symbol, horizon, y, avg(brier) AS brier, avg(prior_brier) AS prior_brier, avg(good) AS accuracy FROM v GROUP BY 1, 2, 3)"""


def _gains(spark, d, horizons=P.horizons):
    """Gains of the regime's probability over the prior's, for each horizon: Brier, accuracy, and whether it was right."""
    b = bars(spark, d)
    out = None
    for h in horizons:
        right = lambda c: (sc.classify(c) == F.col("target")).cast("double")
        gain = (F.col("prior") - F.col("target")) ** 2 - (F.col("regime") - F.col("target")) ** 2
        part = wide(spark, d, h, b).withColumns({"horizon": F.lit(h), "gain": gain, "good": right("regime"), "more": right("regime") - right("prior"), "year": F.year("date")})
        part = part.select("symbol", "horizon", "date", "year", "target", "prior", "regime", "gain", "good", "more")
        out = part if out is None else out.unionByName(part)
    return checkpointed(out)


def _yearly(g):
    b = lambda c: F.avg((F.col(c) - F.col("target")) ** 2)
    return g.groupBy("symbol", "horizon", "year").agg(b("regime").alias("brier"), b("prior").alias("prior_brier"), F.avg("good").alias("accuracy"))


def _bounds(g, value):
    return boot.mean_intervals(g, ["symbol", "horizon"], value, blocks=P.blocks, reps=P.reps, seed=P.seed)


@query("c8_ci_envelope", f"{_EVIDENCE} SELECT symbol, horizon::BIGINT AS horizon, round(min(low), 6) AS low, round(max(high), 6) AS high FROM iv GROUP BY 1, 2")
def c8e(spark, d):
    return r6(sc.ci_envelope(_bounds(_gains(spark, d), "gain"), ["symbol", "horizon"]))


@query("u4_evidence_gate", f"{_EVIDENCE} SELECT symbol, certain, no_year_worse, certain AND no_year_worse AS evidence FROM (SELECT symbol, bool_and(low > 0 AND more_low > 0) AS certain FROM iv GROUP BY 1) JOIN (SELECT symbol, bool_and(brier <= prior_brier) AS no_year_worse FROM yr GROUP BY 1) USING (symbol)")
def u4(spark, d):
    g = _gains(spark, d)
    return boot.evidence_gate(_bounds(g, "gain").unionByName(_bounds(g, "more")), _yearly(g), ["symbol"])


@query("u5_primary_goal", f"{_EVIDENCE} SELECT symbol, achieved, every_year, every_bound FROM (SELECT symbol, avg(good) > 0.9 AS achieved FROM v WHERE horizon = 7 GROUP BY 1) JOIN (SELECT symbol, bool_and(accuracy > 0.9) AS every_year FROM yr WHERE horizon = 7 GROUP BY 1) USING (symbol) JOIN (SELECT symbol, bool_and(good_low > 0.9) AS every_bound FROM iv WHERE horizon = 7 GROUP BY 1) USING (symbol)")
def u5(spark, d):
    g = _gains(spark, d, (7,))
    overall = g.groupBy("symbol").agg(F.avg("good").alias("accuracy"), F.lit(1.0).alias("coverage"))
    return boot.primary_goal(overall, _yearly(g), _bounds(g, "good"), ["symbol"])


@query("l7_paired_tables", f"{S.FOLDS} SELECT symbol, count(*) AS n, round(avg(regime - prior), 6) AS mean_difference, round(avg((prior - target) ** 2 - (regime - target) ** 2), 6) AS gain FROM wide GROUP BY symbol")
def l7(spark, d):
    p = checkpointed(preds(spark, d))
    of = lambda c: p.where(F.col("candidate") == c).select("symbol", "date", "target", F.col("probability").alias(c))
    both = of("regime").join(of("historical_prior"), ["symbol", "date", "target"])
    gain = (F.col("historical_prior") - F.col("target")) ** 2 - (F.col("regime") - F.col("target")) ** 2
    return r6(both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("regime") - F.col("historical_prior")).alias("mean_difference"), F.avg(gain).alias("gain")))


# ---- serving


@query("v4_reproduce", f"{S.FOLDS} SELECT symbol, cutoff, CASE WHEN month(cutoff) = 6 THEN 'ups' ELSE 'missing_in_b' END AS what FROM cnt WHERE month(cutoff) IN (6, 9)")
def v4(spark, d):
    """Stored counts of folds, from running sums, against recomputed ones, from the range join; June's were altered, September's are not recomputed."""
    rows = checkpointed(matured(spark, d))
    ups = F.col("ups0") + F.col("ups1") + F.col("ups2")
    stored = wf.expanding_counts(rows, months(spark), ["symbol"]).select("symbol", "cutoff", (F.col("n0") + F.col("n1") + F.col("n2")).alias("n"), (ups + (F.month("cutoff") == 6).cast("long")).alias("ups"))
    joined = lb.folds_of(rows, months(spark)).where("role = 'train' AND month(cutoff) <> 9").groupBy("symbol", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("ups"))
    return sv.reproduce(stored, joined, ["symbol", "cutoff"]).select("symbol", "cutoff", F.concat_ws(",", "what").alias("what"))


_V1 = lambda h: f"""{_CALH(h)}, tb AS (SELECT symbol, score, count(*) AS n, (sum(target) + 1) / (count(*) + 2) AS p, quantile_cont(forward_return, 0.1) AS q10, quantile_cont(forward_return, 0.5) AS q50, quantile_cont(forward_return, 0.9) AS q90 FROM fit GROUP BY 1, 2), pr AS (SELECT symbol, (sum(target) + 1) / (count(*) + 2) AS baseline FROM fit GROUP BY 1)
SELECT l.symbol, date, {h}::BIGINT AS horizon, CAST(l.score AS BIGINT) AS score, round(coalesce(p, 0.5), 6) AS probability, coalesce(n, 0) AS n, round(baseline, 6) AS baseline, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90, date + 2 AS entry_date, date + {h + 2} AS end_date, CASE WHEN coalesce(p, 0.5) >= 0.5 THEN 'up' ELSE 'not_up' END AS direction, round(forward_return, 6) AS realized
FROM lab l JOIN pr USING (symbol) LEFT JOIN tb ON tb.symbol = l.symbol AND tb.score = l.score WHERE l.score IS NOT NULL AND date >= DATE '2000-01-01'"""


def _forecasts(spark, d, horizon, b):
    return sv.forecast(ind(spark, d, b), sv.calibration_record(checkpointed(_split(spark, d, horizon, b).where("part = 'calibration'"))), horizon, start=P.holdout_start)


@query("v1_forecast", f"SELECT * FROM ({_V1(7)}) UNION ALL SELECT * FROM ({_V1(30)})")
def v1(spark, d):
    b = bars(spark, d)
    return r6(_forecasts(spark, d, 7, b).unionByName(_forecasts(spark, d, 30, b)))


_SERVE = f"{S.FOLDS}, sv0 AS (SELECT b.symbol, b.date, b.close, w.prior AS hist, f.prior AS frozen FROM bars b LEFT JOIN wide w ON w.symbol = b.symbol AND w.date = b.date AND w.date < DATE '2001-06-01' LEFT JOIN prob2 f ON f.symbol = b.symbol AND f.cutoff = date_trunc('month', b.date) AND b.date >= DATE '2001-09-01'), sv1 AS (SELECT s.*, CASE WHEN hist IS NOT NULL THEN 'historical' WHEN frozen IS NOT NULL THEN 'frozen' ELSE 'unavailable' END AS mode, coalesce(hist, frozen) AS probability, n.close / s.close - 1 AS realized FROM sv0 s LEFT JOIN bars n ON n.symbol = s.symbol AND n.date = s.date + 7)"


def _served(spark, d):
    b = bars(spark, d)
    rows = checkpointed(matured(spark, d, 7, b))
    probs = checkpointed(fold_probs(spark, rows))
    w = wf.predictions(rows, probs, ["symbol"]).where("date < '2001-06-01'").select("symbol", "date", F.col("prior").alias("probability"))
    frozen = probs.where("cutoff >= '2001-09-01'").select("symbol", F.col("cutoff").alias("refit_date"), F.add_months("cutoff", 1).alias("valid_until"), F.lit("historical_prior").alias("selected"), F.col("prior").alias("probability"))
    return sv.research_forecast(b, w, frozen, 7)


@query("l9_l11_v2_research_forecast", f"{_SERVE} SELECT symbol, date, 7::BIGINT AS horizon, mode, round(probability, 6) AS probability, date + 7 AS end_date, round(realized, 6) AS realized FROM sv1")
def v2(spark, d):
    return r6(_served(spark, d).drop("reason"))


@query("v3_outcome_status", f"{_SERVE} SELECT symbol, CASE WHEN date + 7 > DATE '2001-10-01' THEN 'immature' WHEN realized IS NULL THEN 'missing' WHEN (realized > 0) = (probability >= 0.5) THEN 'right' ELSE 'wrong' END AS status, count(*) AS n FROM sv1 WHERE mode <> 'unavailable' GROUP BY 1, 2")
def v3(spark, d):
    return sv.outcome_status(_served(spark, d).where("mode <> 'unavailable'"), date(2001, 10, 1)).groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"))


@query("v5_leakage_checks", f"{S.BASE} SELECT symbol, max(date) AS date, 'peek' AS what FROM bars WHERE date <= DATE '2000-06-30' GROUP BY symbol")
def v5(spark, d):
    """Later prices are tripled: no indicator may change before, but a planted one that looks a bar ahead does."""
    b = bars(spark, d)
    cut = date(2000, 6, 30)
    later = b.withColumns({c: F.when(F.col("date") > F.lit(cut), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    f = lambda x: ft.indicators(x, P).select("symbol", "date", "sma", "momentum", "vol", "score", "weight", F.lead("close").over(by_symbol()).alias("peek"))
    return sv.leaks(f(b), f(later), ["symbol", "date"], cut).select("symbol", "date", F.concat_ws(",", "what").alias("what"))


_NUM = lambda c: f"CAST(round({c}, 6) AS VARCHAR)"


@query("s7_signal_export", f"""WITH f AS (SELECT * FROM ({_V1(7)})), la AS (SELECT symbol, max_by(probability, date) AS probability, max_by(direction, date) AS direction FROM f GROUP BY 1), m AS (SELECT symbol, total, accuracy FROM ({_SCORED} SELECT symbol, {S.METRICS} FROM sco GROUP BY symbol)), i AS (SELECT symbol, max(date) AS date, max_by(score, date) AS score FROM ({S.BASE} SELECT symbol, date, score FROM ind) GROUP BY 1)
SELECT symbol, 7::BIGINT AS horizon, '{{"date":"' || i.date || '","score":' || score || ',"probability":' || {_NUM('probability')} || ',"direction":"' || direction || '","accuracy":' || {_NUM('accuracy')} || ',"total":' || total || ',"correct":' || CAST(round(accuracy * total) AS BIGINT) || '}}' AS payload FROM i JOIN la USING (symbol) JOIN m USING (symbol)""")
def s7(spark, d):
    b = bars(spark, d)
    f = r6(_forecasts(spark, d, 7, b))
    newest = f.groupBy("symbol").agg(F.max_by(F.struct("horizon", "probability", "direction"), "date").alias("x")).select("symbol", "x.*")
    m = sc.metrics(_scored(spark, d, 7, b), ["symbol"]).select("symbol", F.lit(7).cast("long").alias("horizon"), F.round("accuracy", 6).alias("accuracy"), "total")
    return io.signal_export(ft.latest_signal(ind(spark, d, b)).select("symbol", "date", "score"), newest, m)


# ---- bars of the event stream, as a table


@query("t1_event_bars", "SELECT event_type AS symbol, date_trunc('hour', ts) AS start, round(first(value ORDER BY ts, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(last(value ORDER BY ts, event_id), 6) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2")
def t1(spark, d):
    ticks = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    return r6(st.daily_bars(ticks, width="1 hour")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t4_quote_overlay", "WITH b AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, round(last(value ORDER BY ts, event_id), 6) AS close FROM events GROUP BY 1, 2), q AS (SELECT event_type AS symbol, round(max_by(value, event_id), 6) AS quote FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT b.symbol, date, close, quote FROM b LEFT JOIN q USING (symbol)")
def t4(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    quotes = e.where("symbol <> 'view'").select("symbol", "price", F.col("event_id").alias("received_at"))
    return r6(st.with_quotes(st.daily_bars(e), quotes).select("symbol", F.to_date("start").alias("date"), "close", "quote"))


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LATEST = f"""WITH RECURSIVE tk AS (SELECT l_linestatus AS base, CAST(l_shipdate AS DATE) AS date, first(l_extendedprice ORDER BY {_KEYS}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, last(l_extendedprice ORDER BY {_KEYS}) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
sg AS (SELECT *, sum(CAST(coalesce(date - p > 1, false) AS INT)) OVER (PARTITION BY base ORDER BY date) AS seg FROM (SELECT *, lag(date) OVER (PARTITION BY base ORDER BY date) AS p FROM tk)),
bars AS (SELECT base || '#' || seg AS symbol, base, date, open, high, low, close, volume FROM sg),{S.DAILY},{S.indicators()}
SELECT base AS symbol, {sel('date *open *high *low *close *volume *sma *momentum *vol #score *weight')}, date + 2 AS earliest_execution FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY date DESC) AS i FROM ind) WHERE i = 1"""


@query("s9_latest_signals", _LATEST)
def flagship(spark, d):
    return r6(latest_signals(spark, d))
