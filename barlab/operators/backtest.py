"""Simulation of target weights with costs and a no-trade band."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from barlab.functions.storage import checkpointed
from barlab.functions.windows import by_symbol
from barlab.operators import features
from barlab.operators.labels import next_open_return
from barlab.schemas import STRATEGIES, Protocol

DAILY = "symbol string, scenario string, strategy string, execution_date date, return double, weight double, turnover double, cost_fraction double, equity double"


@dataclass(frozen=True)
class Scenario:
    """One run of all strategies: its period, costs, lag and indicator windows."""

    name: str
    start: date
    stop: date
    cost_bps: float = 15.0
    lag: int = 2
    sma: int = 200
    momentum: int = 63


def period_scenarios(p: Protocol) -> list[Scenario]:
    base = Scenario("full", p.research_start, p.data_end, p.cost_bps, p.lag, p.sma, p.momentum)
    return [replace(base, name="calibration", stop=p.calibration_end), replace(base, name="validation", start=p.calibration_end, stop=p.holdout_start), replace(base, name="holdout", start=p.holdout_start), base]


def yearly_scenarios(p: Protocol, first: int, last: int) -> list[Scenario]:
    """Each calendar year from cash."""
    return [Scenario(f"year_{y}", date(y, 1, 1), min(date(y + 1, 1, 1), p.data_end), p.cost_bps, p.lag, p.sma, p.momentum) for y in range(first, last + 1)]


def sensitivity_scenarios(p: Protocol) -> list[Scenario]:
    return [Scenario(f"sma{s}_mom{m}", p.holdout_start, p.data_end, p.cost_bps, p.lag, s, m) for s in p.sma_grid for m in p.momentum_grid]


def stress_scenarios(p: Protocol) -> list[Scenario]:
    base = Scenario("", p.holdout_start, p.data_end, p.cost_bps, p.lag, p.sma, p.momentum)
    return [replace(base, name=f"cost_{c:g}", cost_bps=c) for c in p.cost_stress] + [replace(base, name=f"delay_{d}", lag=d) for d in p.lag_stress]


def run_weights(returns: np.ndarray, target: np.ndarray, active: np.ndarray, cost: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Net return, weight, turnover and fee of each day (rows) and run (columns), from cash."""
    return run_weights_from(np.zeros(target.shape[1]), returns, target, active, cost, band)[:4]


def run_weights_from(held: np.ndarray, returns: np.ndarray, target: np.ndarray, active: np.ndarray, cost: np.ndarray, band: float) -> tuple[np.ndarray, ...]:
    """Net return, weight, turnover and fee of each day (rows) and run (columns), and the weights held after the last day; ``held``: those before the first.

    A run trades to its target if that is ``band`` away or more, on leaving
    the market and on entering it; otherwise the weight that prices have
    drifted to stays. Days outside ``active`` change nothing.
    """
    days, runs = target.shape
    out = [np.zeros((days, runs)) for _ in range(4)]
    for t in range(days):
        on, goal, r = active[t], target[t], returns[t]
        move = goal - held
        trade = on & ((np.abs(move) >= band) | ((goal == 0) & (held != 0)) | ((goal > 0) & (held == 0)))
        turnover = np.where(trade, np.abs(move / np.where(move >= 0, 1 + cost * goal, 1 - cost * goal)), 0.0)
        weight = np.where(trade, goal, held)
        fee = cost * turnover
        grown = 1 + weight * r
        for x, value in zip(out, ((1 - fee) * grown - 1, weight, turnover, fee), strict=True):
            x[t] = np.where(on, value, 0.0)
        held = np.where(on, weight * (1 + r) / grown, held)
    return *out, held


def _stepped(days: pd.DataFrame, runs: list[tuple[str, str, float]], band: float, start: np.ndarray | None = None) -> tuple[pd.DataFrame, np.ndarray, tuple[np.ndarray, ...]]:
    """Days in order, which of them count for each run, and run_weights of them."""
    days = days.sort_values("date")
    target = np.array([[np.nan if x is None else x for x in row] for row in days["targets"]], float).reshape(len(days), len(runs))
    active = ~np.isnan(target)
    target = np.nan_to_num(target)
    if ((target < 0) | (target > 1)).any():
        raise ValueError("a target weight lies outside 0 and 1")
    return days, active, run_weights_from(np.zeros(len(runs)) if start is None else start, days["next_return"].fillna(0.0).to_numpy(float), target, active, np.array([c for _, _, c in runs]), band)


def _records(days: pd.DataFrame, active: np.ndarray, parts: tuple[np.ndarray, ...], runs: list[tuple[str, str, float]], before: np.ndarray | float = 1.0) -> pd.DataFrame:
    """Rows of DAILY; ``before``: each run's equity before the first day."""
    equity = before * np.cumprod(1 + parts[0], axis=0)
    day, run = np.nonzero(active)
    return pd.DataFrame(
        {
            "symbol": days["symbol"].iloc[0],
            "scenario": np.array([x for x, _, _ in runs], object)[run],
            "strategy": np.array([x for _, x, _ in runs], object)[run],
            "execution_date": days["date"].to_numpy()[day],
            "return": parts[0][day, run],
            "weight": parts[1][day, run],
            "turnover": parts[2][day, run],
            "cost_fraction": parts[3][day, run],
            "equity": equity[day, run],
        }
    )


def simulate(frame: DataFrame, runs: list[tuple[str, str, float]], band: float) -> DataFrame:
    """Daily records of every run. ``frame``: symbol, date, next_return and ``targets``, an array with a weight or null for each run (scenario, strategy, cost).

    One group per symbol holds that symbol's days; all runs step through them
    together. A weight outside [0, 1] is an error.
    """

    def group(days: pd.DataFrame) -> pd.DataFrame:
        return _records(*_stepped(days, runs, band), runs)

    return frame.select("symbol", "date", "next_return", "targets").groupBy("symbol").applyInPandas(group, DAILY)


def simulate_in_pieces(frame: DataFrame, runs: list[tuple[str, str, float]], band: float, *, days: int = 365) -> DataFrame:
    """What ``simulate`` gives, for series longer than a task: pieces of ``days`` days run side by side.

    What a piece needs of those before it is the weight held at its start.
    Every run trades to its target now and then (a target of 0 always does),
    and from then on nothing is left of that weight. So all pieces first run
    from cash; where the one before ended otherwise than was assumed, a piece
    runs again, until every assumption holds. That takes two or three rounds,
    each over fewer pieces, and is exact in any number of them; a run that
    never trades takes as many as it has pieces.
    """
    at = ["symbol", "piece"]
    cut = checkpointed(frame.select("symbol", "date", "next_return", "targets", F.floor(F.unix_date("date") / days).alias("piece")))
    cash = F.array(*[F.lit(0.0)] * len(runs))
    line = Window.partitionBy("symbol").orderBy("piece")

    def ends(key: tuple, some: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(begun):
            return pd.DataFrame(columns=[*at, "started", "ended", "growth"])
        start = np.array(begun["start"].iloc[0], float)
        parts = _stepped(some, runs, band, start)[2]
        return pd.DataFrame({"symbol": [key[0]], "piece": [key[1]], "started": [start.tolist()], "ended": [parts[4].tolist()], "growth": [np.prod(1 + parts[0], axis=0).tolist()]})

    def run(begin: DataFrame) -> DataFrame:
        both = cut.groupBy(*at).cogroup(begin.groupBy(*at))
        return checkpointed(both.applyInPandas(ends, "symbol string, piece long, started array<double>, ended array<double>, growth array<double>"))

    state = run(cut.select(*at).distinct().withColumn("start", cash))
    while True:
        follows = state.withColumn("start", F.coalesce(F.lag("ended").over(line), cash))
        wrong = checkpointed(follows.where(F.col("start") != F.col("started")).select(*at, "start"))
        if wrong.isEmpty():
            break
        state = checkpointed(state.join(wrong.select(*at), at, "left_anti").unionByName(run(wrong)))
    each = state.select(*at, "started", F.posexplode("growth").alias("run", "growth"))
    grown = F.coalesce(F.product("growth").over(Window.partitionBy("symbol", "run").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    before = each.withColumn("grown", grown).groupBy(*at, "started").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "grown"))), lambda x: x["grown"]).alias("before"))

    def records(key: tuple, some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _records(*_stepped(some, runs, band, np.array(known["started"].iloc[0], float)), runs, np.array(known["before"].iloc[0], float))

    return cut.groupBy(*at).cogroup(before.groupBy(*at)).applyInPandas(records, DAILY)


def backtest(bars: DataFrame, scenarios: list[Scenario], p: Protocol = Protocol(), *, piece_days: int | None = None) -> DataFrame:
    """Daily records of all strategies in all scenarios, from one pass over the bars.

    Indicators are computed once for each window length; a scenario only picks
    from them. A day counts in a scenario if it lies in its period, has a next
    open, and all strategies' lagged weights are known. With ``piece_days``
    long series are simulated in pieces of so many days.
    """
    daily = features.with_daily(bars)
    smas, moms = sorted({s.sma for s in scenarios}), sorted({s.momentum for s in scenarios})
    got = daily.withColumns({f"sma_{n}": features.sma(n) for n in smas} | {f"mom_{n}": features.momentum(n) for n in moms} | {"vol": features.realized_vol(p.vol, p.annual), "next_return": next_open_return()})
    weight = features.vol_target_weight(F.col("vol"), p)
    decided, names = {}, {}
    for s in scenarios:
        key = (s.sma, s.momentum)
        if key in names:
            continue
        names[key] = f"w_{s.sma}_{s.momentum}"
        a, m = F.col(f"sma_{s.sma}"), F.col(f"mom_{s.momentum}")
        known = a.isNotNull() & m.isNotNull() & F.col("vol").isNotNull()
        both = (F.col("close") > a) & (m > 0)
        decided[names[key]] = F.when(known, F.array(F.when(both, weight).otherwise(0.0), F.lit(1.0), (F.col("close") > a).cast("double"), weight))
    got = got.withColumns(decided)
    w = by_symbol()
    lagged = {(s.sma, s.momentum, s.lag) for s in scenarios}
    got = got.withColumns({f"{names[a, b]}_{k}": F.lag(names[a, b], k).over(w) for a, b, k in lagged})
    cells, runs = [], []
    for s in scenarios:
        at = F.col(f"{names[s.sma, s.momentum]}_{s.lag}")
        inside = (F.col("date") >= F.lit(s.start)) & (F.col("date") < F.lit(s.stop)) & F.col("next_return").isNotNull()
        for i, strategy in enumerate(STRATEGIES):
            cells.append(F.when(inside, F.get(at, F.lit(i))))
            runs.append((s.name, strategy, s.cost_bps / 10_000))
    frame = got.select("symbol", "date", "next_return", F.array(*cells).alias("targets"))
    return simulate(frame, runs, p.band) if piece_days is None else simulate_in_pieces(frame, runs, p.band, days=piece_days)
