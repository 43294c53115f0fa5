"""Statistics of simulated days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.windows import ratio

KEYS = ["symbol", "scenario", "strategy"]


def _w(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("execution_date")


def equity_curve(daily: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``daily`` with equity (1 before the first day), drawdown and segment of days under water."""
    w = _w(keys).rowsBetween(Window.unboundedPreceding, 0)
    equity = F.product(1 + F.col("return")).over(w)
    got = daily.withColumn("equity", equity)
    return got.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)


def _with_underwater(curve: DataFrame, keys: list[str]) -> DataFrame:
    """``curve`` with underwater_days: for how many days in a row the equity has been below its highest so far."""
    w = _w(keys)
    placed = curve.withColumn("__at", F.row_number().over(w))
    above = F.max(F.when(F.col("drawdown") >= -1e-12, F.col("__at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("underwater_days", (F.col("__at") - F.coalesce(above, F.lit(0))).cast("long")).drop("__at")


def longest_underwater(curve: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The longest run of days below the highest equity so far."""
    return _with_underwater(curve, keys).groupBy(*keys).agg(F.max("underwater_days").alias("longest_underwater_days"))


def performance_stats(daily: DataFrame, keys: list[str] = KEYS, annual: int = 365) -> DataFrame:
    curve = _with_underwater(equity_curve(daily, keys), keys)
    r = F.col("return")
    got = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.min("execution_date").alias("start_open"),
        F.date_add(F.max("execution_date"), 1).alias("end_valuation_open"),
        F.max_by("equity", "execution_date").alias("__equity"),
        F.stddev_samp(r).alias("__sd"),
        F.avg(r).alias("__mean"),
        F.min("drawdown").alias("max_drawdown"),
        F.min(r).alias("worst_day"),
        F.avg("weight").alias("mean_position"),
        F.avg((F.col("weight") > 0).cast("double")).alias("exposed_days_fraction"),
        F.count_if(F.col("turnover") > 1e-12).alias("trading_days"),
        F.sum("turnover").alias("one_way_turnover"),
        F.sum("cost_fraction").alias("sum_cost_fractions"),
        F.max("underwater_days").alias("longest_underwater_days"),
    )
    vol = F.col("__sd") * F.sqrt(F.lit(float(annual)))
    cagr = F.pow("__equity", F.lit(float(annual)) / F.col("days")) - 1
    return got.withColumns(
        {
            "total_return": F.col("__equity") - 1,
            "cagr": cagr,
            "annual_volatility": vol,
            "sharpe": F.when(vol == 0, 0.0).otherwise(ratio(F.col("__mean") * annual, vol)),
            "calmar": F.when(F.col("max_drawdown") == 0, 0.0).otherwise(ratio(cagr, -F.col("max_drawdown"))),
        }
    ).drop("__equity", "__sd", "__mean")


def rolling_return(daily: DataFrame, days: int = 1095, keys: list[str] = KEYS) -> DataFrame:
    """Windows, the lowest return and the share of positive ones over ``days`` rows, from the equity at both ends."""
    w = _w(keys)
    curve = equity_curve(daily, keys).withColumns({"__n": F.row_number().over(w), "__then": F.lag("equity", days).over(w)})
    start = F.when(F.col("__n") == days, F.lit(1.0)).otherwise(F.col("__then"))
    got = curve.withColumn("__r", ratio(F.col("equity"), start) - 1).where("__r IS NOT NULL")
    return got.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.min("__r").alias("lowest"), F.avg((F.col("__r") > 0).cast("double")).alias("positive_share"))


def acceptance_gates(stats: DataFrame, sharpe_intervals: DataFrame, brier_intervals: DataFrame, *, model: str = "trend_model", worst_drawdown: float = -0.35, neighbours: int = 7, neighbour_drawdown: float = -0.4) -> DataFrame:
    """Pass or fail of the nine rules for each symbol, and of all together.

    ``stats``: performance_stats of the holdout, grid and stress scenarios;
    ``sharpe_intervals``: low of the Sharpe difference with vol_hold, a row per
    block length; ``brier_intervals``: low of the Brier improvement, a row per
    horizon and block length. What is missing does not pass.
    """
    own = F.col("strategy") == model
    one = lambda scenario, c, strategy=model: F.max(F.when((F.col("scenario") == scenario) & (F.col("strategy") == strategy), F.col(c)))
    fine = own & F.col("scenario").startswith("sma") & (F.col("cagr") > 0) & (F.col("max_drawdown") >= neighbour_drawdown)
    got = stats.groupBy("symbol").agg(
        (one("holdout", "cagr") > 0).alias("cagr_positive"),
        (one("holdout", "max_drawdown") >= worst_drawdown).alias("drawdown_bounded"),
        (one("holdout", "sharpe") > one("holdout", "sharpe", "buy_hold")).alias("sharpe_above_buy_hold"),
        (one("holdout", "sharpe") > one("holdout", "sharpe", "vol_hold")).alias("sharpe_above_vol_hold"),
        (F.count_if(fine) >= neighbours).alias("neighbours_fine"),
        (one("cost_50", "cagr") > 0).alias("cost_stress_positive"),
        (one("delay_3", "cagr") > 0).alias("delay_stress_positive"),
    )
    sure = lambda df, name: df.groupBy("symbol").agg(F.every(F.col("low") > 0).alias(name))
    gates = ["cagr_positive", "drawdown_bounded", "sharpe_above_buy_hold", "sharpe_above_vol_hold", "sharpe_gain_certain", "brier_gain_certain", "neighbours_fine", "cost_stress_positive", "delay_stress_positive"]
    both = got.join(sure(sharpe_intervals, "sharpe_gain_certain"), "symbol", "left").join(sure(brier_intervals, "brier_gain_certain"), "symbol", "left").fillna(False, gates)
    accepted: Column = F.lit(True)
    for g in gates:
        accepted = accepted & F.col(g)
    return both.select("symbol", *gates, accepted.alias("accepted"))
