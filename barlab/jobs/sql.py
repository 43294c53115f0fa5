"""Common table expressions for the SQL that the queries are held against."""

from __future__ import annotations

INDEX = """
d AS (SELECT l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, sum(CAST(l_discount AS DECIMAL(10,2))) AS sd, sum(CAST(l_tax AS DECIMAL(10,2))) AS st, count(*) AS k, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
d1 AS (SELECT symbol, date, CAST(sd AS DOUBLE) / k - 0.05 AS r, CAST(st AS DOUBLE) / k AS t, volume FROM d),
d2 AS (SELECT *, 100 * exp(4 * sum(r) OVER (PARTITION BY symbol ORDER BY date)) AS close FROM d1),
d3 AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), 100.0) * (1 + t - 0.04) AS open FROM d2),
bars AS (SELECT symbol, date, open, greatest(open, close) * (1 + t / 4) AS high, least(open, close) * (1 - t / 4) AS low, close, volume FROM d3)"""


def full(n: int, agg: str, arg: str) -> str:
    w = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({arg}) OVER {w} = {n} THEN {agg}({arg}) OVER {w} END"


def lag(arg: str, n: int = 1) -> str:
    return f"lag({arg}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def lead(arg: str, n: int = 1) -> str:
    return f"lead({arg}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


DAILY = f"""
daily AS (SELECT *, ln(close) - {lag('ln(close)')} AS log_return, close - {lag('close')} AS change,
  greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS true_range, ln(1 + volume) AS log_volume FROM bars)"""


def indicators(sma: int = 200, mom: int = 63, vol: int = 30, name: str = "ind") -> str:
    return f"""
{name}0 AS (SELECT *, {full(sma, 'avg', 'close')} AS sma, close / {lag('close', mom)} - 1 AS momentum, {full(vol, 'stddev_samp', 'log_return')} * sqrt(365.0) AS vol FROM daily),
{name} AS (SELECT *, CASE WHEN sma IS NOT NULL AND momentum IS NOT NULL AND vol IS NOT NULL THEN CAST(close > sma AS INT) + CAST(momentum > 0 AS INT) END AS score,
  CASE WHEN vol = 0 THEN 1.0 WHEN vol IS NOT NULL THEN greatest(0.0, least(1.0, 0.4 / vol)) END AS weight FROM {name}0)"""


#: bars, daily and the indicators of the protocol
BASE = f"WITH RECURSIVE {INDEX},{DAILY},{indicators()}"

CTC = lambda h: f"""
lab AS (SELECT *, {lead('close', h)} / close - 1 AS forward_return, date + {h} AS label_end, CAST({lead('close', h)} / close - 1 > 0 AS INT) AS target FROM ind)"""

OTO = lambda h, k=2: f"""
lab AS (SELECT *, {lead('open', k + h)} / {lead('open', k)} - 1 AS forward_return, date + {k + h} AS label_end, CAST({lead('open', k + h)} / {lead('open', k)} - 1 > 0 AS INT) AS target FROM ind)"""

METRICS = """count(*) AS total, count(*) FILTER (WHERE probability >= 0.5 AND target = 1) AS tp, count(*) FILTER (WHERE probability < 0.5 AND target = 0) AS tn,
count(*) FILTER (WHERE probability >= 0.5 AND target = 0) AS fp, count(*) FILTER (WHERE probability < 0.5 AND target = 1) AS fn,
round(avg(CAST((probability >= 0.5) = (target = 1) AS INT)), 6) AS accuracy,
round(count(*) FILTER (WHERE probability >= 0.5 AND target = 1) / nullif(count(*) FILTER (WHERE target = 1), 0), 6) AS up_recall,
round(count(*) FILTER (WHERE probability < 0.5 AND target = 0) / nullif(count(*) FILTER (WHERE target = 0), 0), 6) AS down_recall,
round((count(*) FILTER (WHERE probability >= 0.5 AND target = 1) / nullif(count(*) FILTER (WHERE target = 1), 0) + count(*) FILTER (WHERE probability < 0.5 AND target = 0) / nullif(count(*) FILTER (WHERE target = 0), 0)) / 2, 6) AS balanced_accuracy,
round(avg(target), 6) AS observed_up, round(avg(CAST(probability >= 0.5 AS INT)), 6) AS predicted_up, round(avg((probability - target) ** 2), 6) AS brier,
round(avg(-(target * ln(greatest(1e-12, least(1 - 1e-12, probability))) + (1 - target) * ln(1 - greatest(1e-12, least(1 - 1e-12, probability))))), 6) AS log_loss"""

def folds(h: int = 7) -> str:
    """Monthly folds, expanding counts and probabilities from close-to-close labels of h days; predictions of each row."""
    a = 3 * h
    return f"""{BASE},{CTC(h)},
rows AS (SELECT symbol, date, label_end, score, target, forward_return, close FROM lab WHERE score IS NOT NULL AND target IS NOT NULL AND date >= DATE '1996-01-01'),
cut AS (SELECT CAST(c AS DATE) AS cutoff FROM (SELECT unnest(generate_series(DATE '1998-01-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS c)),
cnt AS (SELECT s.symbol, cutoff, count(*) FILTER (WHERE score = 0) AS n0, count(*) FILTER (WHERE score = 0 AND target = 1) AS ups0, count(*) FILTER (WHERE score = 1) AS n1,
  count(*) FILTER (WHERE score = 1 AND target = 1) AS ups1, count(*) FILTER (WHERE score = 2) AS n2, count(*) FILTER (WHERE score = 2 AND target = 1) AS ups2
  FROM (SELECT DISTINCT symbol FROM rows) s CROSS JOIN cut LEFT JOIN rows r ON r.symbol = s.symbol AND r.label_end < cutoff GROUP BY 1, 2),
prob AS (SELECT *, n0 + n1 + n2 AS train_rows, (ups0 + ups1 + ups2 + 1) / (n0 + n1 + n2 + 2) AS prior FROM cnt),
prob2 AS (SELECT *, (ups0 + {a} * prior) / (n0 + {a}) AS p0, (ups1 + {a} * prior) / (n1 + {a}) AS p1, (ups2 + {a} * prior) / (n2 + {a}) AS p2 FROM prob WHERE train_rows >= 365),
wide AS (SELECT r.symbol, r.date, r.label_end, r.target, r.score, r.close, cutoff, prior, CASE score WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS regime FROM rows r JOIN prob2 p ON p.symbol = r.symbol AND p.cutoff = date_trunc('month', r.date)),
preds AS (SELECT symbol, date, label_end, target, 'historical_prior' AS candidate, prior AS probability FROM wide UNION ALL SELECT symbol, date, label_end, target, 'regime', regime FROM wide UNION ALL SELECT symbol, date, label_end, target, 'always_up', 1.0 FROM wide),
sel0 AS (SELECT symbol, cutoff, candidate, year(date) AS y, avg((probability - target) ** 2) AS b, count(*) AS n FROM preds JOIN (SELECT DATE '2000-01-01' AS cutoff UNION ALL SELECT DATE '2001-01-01') o ON label_end < cutoff WHERE candidate <> 'always_up' GROUP BY 1, 2, 3, 4),
sel1 AS (SELECT symbol, cutoff, candidate, avg(b) AS mean_annual_brier, sum(n)::BIGINT AS validation_rows FROM sel0 GROUP BY 1, 2, 3),
sel AS (SELECT symbol, cutoff, candidate AS selected, mean_annual_brier, validation_rows FROM (SELECT *, row_number() OVER (PARTITION BY symbol, cutoff ORDER BY mean_annual_brier, CASE candidate WHEN 'historical_prior' THEN 1 ELSE 2 END) AS i FROM sel1) WHERE i = 1)"""


FOLDS = folds()


def bootstrap(source: str, keys: str, values: str, blocks: tuple[int, ...], reps: int, seed: int) -> str:
    """CTEs up to resamples: keys, b, rep and the values' aggregates over circular blocks of ``source``, which has keys, date and what the aggregates read."""
    longest = max(blocks)
    return f"""
pos AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS pos FROM {source}), len AS (SELECT {keys}, count(*) AS n FROM {source} GROUP BY ALL),
bl AS (SELECT {keys}, n, b, rep, CAST('0x' || substr(md5('{seed}|' || rep || '|' || bn), 1, 8) AS BIGINT) % n AS s, least(b, n - bn * b) AS sz FROM len, (SELECT unnest({list(blocks)}) AS b) c, (SELECT unnest(range({reps})) AS rep) r, (SELECT unnest(range(2000)) AS bn) q WHERE bn < ceil(n / b)),
pick AS (SELECT {keys}, b, rep, (s + k) % n AS pos FROM bl, (SELECT unnest(range({longest})) AS k) t WHERE k < sz),
resamples AS (SELECT {keys}, b, rep, {values} FROM pick JOIN pos USING ({keys}, pos) GROUP BY {keys}, b, rep)"""


def simulated(scenarios: list) -> str:
    """CTEs up to eq: every scenario and strategy stepped day by day, with equity and drawdown."""
    names = {(x.sma, x.momentum): f"i{x.sma}_{x.momentum}" for x in scenarios}
    ctes = [f"WITH RECURSIVE {INDEX}", DAILY, *[indicators(a, b, name=n) for (a, b), n in names.items()]]
    parts = []
    for k, x in enumerate(scenarios):
        n = x.lag
        ctes.append(f"""
act{k} AS (SELECT symbol, date, {lead('open')} / open - 1 AS r, {lag('score', n)} AS s, {lag('weight', n)} AS w, {lag('close', n)} > {lag('sma', n)} AS up FROM {names[x.sma, x.momentum]})""")
        parts.append(f"""SELECT '{x.name}' AS scenario, {x.cost_bps / 10_000}::DOUBLE AS cost, symbol, date, r, unnest(['trend_model', 'buy_hold', 'sma200', 'vol_hold']) AS strategy, unnest([CASE WHEN s = 2 THEN w ELSE 0.0 END, 1.0, CASE WHEN up THEN 1.0 ELSE 0.0 END, w]) AS target
  FROM act{k} WHERE s IS NOT NULL AND r IS NOT NULL AND date >= DATE '{x.start}' AND date < DATE '{x.stop}'""")
    trade = "abs(n.target - s.held) >= 0.05 OR (n.target = 0 AND s.held <> 0) OR (n.target > 0 AND s.held = 0)"
    ctes.append(f"""
tgt AS ({' UNION ALL '.join(parts)}),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol, scenario, strategy ORDER BY date) AS i FROM tgt),
sim AS (
  SELECT symbol, scenario, strategy, 0::BIGINT AS i, NULL::DATE AS date, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS fee, 0.0::DOUBLE AS held, 1.0::DOUBLE AS equity FROM (SELECT DISTINCT symbol, scenario, strategy FROM num)
  UNION ALL
  SELECT symbol, scenario, strategy, i, date, net, w, turn, cost * turn, w * (1 + r) / (1 + w * r), equity * (1 + net)
  FROM (SELECT *, (1 - cost * turn) * (1 + w * r) - 1 AS net FROM (SELECT n.symbol, n.scenario, n.strategy, n.i, n.date, n.r, n.cost, s.equity,
    CASE WHEN {trade} THEN abs((n.target - s.held) / (CASE WHEN n.target >= s.held THEN 1 + n.cost * n.target ELSE 1 - n.cost * n.target END)) ELSE 0.0 END AS turn,
    CASE WHEN {trade} THEN n.target ELSE s.held END AS w
    FROM sim s JOIN num n ON n.symbol = s.symbol AND n.scenario = s.scenario AND n.strategy = s.strategy AND n.i = s.i + 1))),
days AS (SELECT * FROM sim WHERE i > 0),
eq AS (SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY symbol, scenario, strategy ORDER BY i)) - 1 AS drawdown FROM days)""")
    return ",".join(ctes)


UNDER = """un AS (SELECT symbol, scenario, strategy, CAST(max(c) AS BIGINT) AS longest_underwater_days FROM (SELECT symbol, scenario, strategy, g, count(*) FILTER (WHERE u) AS c
FROM (SELECT *, drawdown < -1e-12 AS u, sum(CAST(drawdown >= -1e-12 AS INT)) OVER (PARTITION BY symbol, scenario, strategy ORDER BY i) AS g FROM eq) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


def statistics(scenarios: list, keys: str = "symbol, scenario, strategy") -> str:
    return f"""{simulated(scenarios)}, {UNDER}, ag AS (SELECT symbol, scenario, strategy, count(*) AS days, min(date) AS start_open, max(date) + 1 AS end_valuation_open, max_by(equity, i) AS e, stddev_samp(ret) * sqrt(365.0) AS v, avg(ret) AS m, min(drawdown) AS dd, min(ret) AS worst,
avg(weight) AS pos, avg(CAST(weight > 0 AS INT)) AS expo, count(*) FILTER (WHERE turnover > 1e-12) AS trading_days, sum(turnover) AS turn, sum(fee) AS fees FROM eq GROUP BY 1, 2, 3)
SELECT {keys}, days, start_open, end_valuation_open, round(e - 1, 6) AS total_return, round(e ** (365.0 / days) - 1, 6) AS cagr, round(v, 6) AS annual_volatility, round(CASE WHEN v = 0 THEN 0 ELSE m * 365 / v END, 6) AS sharpe, round(dd, 6) AS max_drawdown,
round(CASE WHEN dd = 0 THEN 0 ELSE (e ** (365.0 / days) - 1) / -dd END, 6) AS calmar, round(worst, 6) AS worst_day, round(pos, 6) AS mean_position, round(expo, 6) AS exposed_days_fraction, trading_days, round(turn, 6) AS one_way_turnover, round(fees, 6) AS sum_cost_fractions, longest_underwater_days FROM ag JOIN un USING (symbol, scenario, strategy)"""
