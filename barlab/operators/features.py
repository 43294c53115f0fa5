"""Rolling indicators and features of bars, and the weights built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.windows import by_symbol, full, ratio
from barlab.schemas import STRATEGIES, Protocol

# fixed values: the study's feature sets
BASIC = ("return_7", "return_30", "return_63", "ma50", "ma200", "vol30", "rsi14", "vol_ratio")
EXPANDED = (*BASIC, "return_1", "return_3", "return_14", "return_126", "ma20", "vol90", "atr14", "volume_z", "range", "close_position")
SQUARES = tuple(f"{c}_sq" for c in BASIC)
PRODUCTS = ("ma200_return63", "rsi_ma200", "return30_vol30")
INTERACTIONS = (*BASIC, *SQUARES, *PRODUCTS)
FEATURE_SETS = {"basic": BASIC, "expanded": EXPANDED, "interactions": INTERACTIONS}


def feature_set(kind: str) -> tuple[str, ...]:
    if kind not in FEATURE_SETS:
        raise ValueError(f"no such feature set: {kind}")
    return FEATURE_SETS[kind]


def sma(n: int, of: str = "close") -> Column:
    return full(n, F.avg, F.col(of))


def momentum(n: int) -> Column:
    return ratio(F.col("close"), F.lag("close", n).over(by_symbol())) - 1


def log_return(n: int) -> Column:
    return F.ln("close") - F.lag(F.ln("close"), n).over(by_symbol())


def with_daily(bars: DataFrame) -> DataFrame:
    """``bars`` with log_return (1 day), change, true_range and log_volume, on which the rolling features stand."""
    before = F.lag("close").over(by_symbol())
    change = F.col("close") - before
    swing = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.withColumns({"log_return": log_return(1), "change": change, "true_range": swing, "log_volume": F.log1p("volume")})


def realized_vol(n: int, annual: int = 365) -> Column:
    """Needs with_daily."""
    return full(n, F.stddev_samp, F.col("log_return")) * F.sqrt(F.lit(float(annual)))


def rsi(n: int = 14) -> Column:
    """Share of gains in the mean moves of n days; 0.5 without moves, null in the warm-up. Needs with_daily."""
    up, down = (full(n, F.avg, F.greatest(s * F.col("change"), F.when(F.col("change").isNotNull(), F.lit(0.0)))) for s in (F.lit(1.0), F.lit(-1.0)))
    return F.when(up + down == 0, F.lit(0.5)).otherwise(ratio(up, up + down))


def indicators(bars: DataFrame, p: Protocol = Protocol()) -> DataFrame:
    """``bars`` with sma, momentum, vol, score (0 to 2) and weight; null in the warm-up."""
    daily = with_daily(bars)
    got = daily.withColumns({"sma": sma(p.sma), "momentum": momentum(p.momentum), "vol": realized_vol(p.vol, p.annual)})
    return scored(got, p).select(*bars.columns, "sma", "momentum", "vol", "score", "weight")


def scored(df: DataFrame, p: Protocol, *, sma_col: str = "sma", momentum_col: str = "momentum", vol_col: str = "vol") -> DataFrame:
    known = F.col(sma_col).isNotNull() & F.col(momentum_col).isNotNull() & F.col(vol_col).isNotNull()
    score = F.when(known, (F.col("close") > F.col(sma_col)).cast("int") + (F.col(momentum_col) > 0).cast("int"))
    return df.withColumns({"score": score, "weight": vol_target_weight(F.col(vol_col), p)})


def vol_target_weight(vol: Column, p: Protocol = Protocol()) -> Column:
    """Target volatility over the realised one, at most max_position; a volatility of 0 gives that."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(p.max_position), ratio(F.lit(p.target_vol), vol)))
    return F.when(vol == 0, F.lit(p.max_position)).when(vol.isNotNull(), bounded)


def strategy_weights(ind: DataFrame) -> DataFrame:
    """A weight column for each strategy, all null until the score is known."""
    known = F.col("score").isNotNull()
    return ind.withColumns(
        {
            "trend_model": F.when(known, F.when(F.col("score") == 2, F.col("weight")).otherwise(0.0)),
            "buy_hold": F.when(known, F.lit(1.0)),
            "sma200": F.when(known, (F.col("close") > F.col("sma")).cast("double")),
            "vol_hold": F.when(known, F.col("weight")),
        }
    )


def weights_long(ind: DataFrame) -> DataFrame:
    return strategy_weights(ind).unpivot(["symbol", "date"], list(STRATEGIES), "strategy", "target")


def all_features(bars: DataFrame, annual: int = 365) -> DataFrame:
    """symbol, date and all features, null where a window is not full or a ratio has no value."""
    daily = with_daily(bars)
    rolling = {f"return_{n}": log_return(n) for n in (1, 3, 7, 14, 30, 63, 126)}
    rolling |= {f"ma{n}": ratio(F.col("close"), sma(n)) - 1 for n in (20, 50, 200)}
    rolling |= {f"vol{n}": realized_vol(n, annual) for n in (30, 90)}
    rolling |= {"rsi14": rsi(14), "atr14": ratio(full(14, F.avg, F.col("true_range")), F.col("close"))}
    rolling |= {"volume_z": ratio(F.col("log_volume") - full(20, F.avg, F.col("log_volume")), full(20, F.stddev_samp, F.col("log_volume")))}
    wide = F.col("high") - F.col("low")
    rolling |= {"range": ratio(wide, F.col("close")), "close_position": F.when(wide == 0, 0.5).otherwise(ratio(F.col("close") - F.col("low"), wide))}
    got = daily.withColumns(rolling)
    known = F.col("ma200").isNotNull() & F.col("return_63").isNotNull()
    more = {"vol_ratio": ratio(F.col("vol30"), F.col("vol90")), "score": F.when(known, (F.col("ma200") > 0).cast("int") + (F.col("return_63") > 0).cast("int"))}
    more |= {f"{c}_sq": F.col(c) * F.col(c) for c in BASIC}
    more |= {"ma200_return63": F.col("ma200") * F.col("return_63"), "rsi_ma200": (F.col("rsi14") - 0.5) * F.col("ma200"), "return30_vol30": F.col("return_30") * F.col("vol30")}
    names = list(dict.fromkeys([*EXPANDED, *INTERACTIONS]))
    return got.withColumns(more).select("symbol", "date", "open", "close", *names, "score")


def day_change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("day_change", ratio(F.col("close"), F.lag("close").over(by_symbol())) - 1)


def range_slice(bars: DataFrame, upto, n: int | None = 90) -> DataFrame:
    """The last n bars (None: all) of each symbol up to a date, with the moving average that needs older bars."""
    got = bars.withColumn("sma", sma(200)).where(F.col("date") <= F.lit(upto))
    if n is None:
        return got
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return got.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= n).drop("__rank")


def latest_signal(ind: DataFrame, lag: int = 2) -> DataFrame:
    """Each symbol's last bar with its indicators, and the first day on which it can be traded."""
    newest = ind.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in ind.columns if c != "symbol"]), "date").alias("x"))
    return newest.select("symbol", "x.*").withColumn("earliest_execution", F.date_add("date", lag))
