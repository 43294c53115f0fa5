"""Queries by the forms that hold for series, groups and tables larger than a task."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.jobs import registry as R, sql as S
from barlab.jobs.panel import index_bars
from barlab.jobs.registry import HOLDOUT, ORACLES, P, bars, query, r6
from barlab.operators import backtest as bt, calibration as cal, chunks, features as ft, nearest, quality as ql


@query("f7_f13_in_chunks", ORACLES["f7_f13_features"])
def f7c(spark, d):
    """All features chunk by chunk: half-years with a halo of 200 rows."""
    return r6(chunks.in_chunks(bars(spark, d), ft.all_features, halo=200, days=183).select("symbol", "date", *ft.EXPANDED))


@query("b1_in_pieces", ORACLES["b1_simulate"])
def b1p(spark, d):
    """The holdout's simulation in pieces of thirty days."""
    return r6(bt.backtest(index_bars(spark, d), HOLDOUT, P, piece_days=30).drop("scenario"))


@query("a4_refined_quantiles", ORACLES["a4_return_quantiles"])
def a4r(spark, d):
    return r6(cal.refined_quantiles(R._fit(spark, d), ["symbol", "score"], "forward_return", cells=16))


@query("d9_by_fingerprints", f"{S.BASE}, x AS (SELECT symbol, date, day(date) = 13 AND month(date) = 3 AS altered, day(date) = 20 AND month(date) = 5 AS gone FROM bars) SELECT symbol, date, CASE WHEN altered THEN 'close' ELSE 'missing_in_b' END AS what, (SELECT count(*) FROM x y WHERE y.symbol = x.symbol AND (altered OR gone)) AS compared FROM x WHERE altered OR gone")
def d9t(spark, d):
    """Bars against a copy with altered and missing days: what differs, and how many rows of the symbol had to be compared."""
    b = bars(spark, d).select("symbol", "date", "open", "close")
    n, m = F.dayofmonth("date"), F.month("date")
    other = b.where(~((n == 20) & (m == 5))).withColumn("close", F.col("close") + F.when((n == 13) & (m == 3), 1.0).otherwise(0.0))
    found, compared = ql.dataset_diff_by_fingerprints(b, other, ["symbol", "date"], tolerance=1e-9)
    counts = compared.groupBy("symbol").agg(F.count(F.lit(1)).alias("compared"))
    return found.select("symbol", "date", F.concat_ws(",", "what").alias("what")).join(counts, "symbol")


_POOLED = R._KNN[: R._KNN.index("tr AS (")]


@query("w8_knn_pooled", f"""{_POOLED} tr AS (SELECT kr.*, cutoff FROM kr JOIN cu ON label_end < cutoff), pa AS (SELECT cutoff, avg(return_7) AS c0, avg(ma200) AS c1, avg(vol30) AS c2, stddev_pop(return_7) AS s0, stddev_pop(ma200) AS s1, stddev_pop(vol30) AS s2 FROM tr GROUP BY 1 HAVING count(*) >= 200),
z AS (SELECT kr.symbol, cutoff, date, label_end, target, greatest(-8, least(8, (return_7 - c0) / s0)) AS z0, greatest(-8, least(8, (ma200 - c1) / s1)) AS z1, greatest(-8, least(8, (vol30 - c2) / s2)) AS z2 FROM kr, pa),
nb AS (SELECT q.symbol, q.date, q.cutoff, t.target, row_number() OVER (PARTITION BY q.symbol, q.date ORDER BY (q.z0 - t.z0) ** 2 + (q.z1 - t.z1) ** 2 + (q.z2 - t.z2) ** 2, t.date, t.symbol) AS k FROM z q JOIN cu USING (cutoff) JOIN z t ON t.cutoff = q.cutoff AND t.label_end < q.cutoff WHERE q.date >= q.cutoff AND q.date < stop)
SELECT symbol, date, cutoff, round((sum(target) + 1) / 52, 6) AS probability FROM nb WHERE k <= 50 GROUP BY 1, 2, 3""")
def w8p(spark, d):
    """Neighbours of every year's rows among all symbols' rows, in blocks of 500 by distance from the centre."""
    return r6(nearest.knn_pooled(R._model_rows(spark, d), ["return_7", "ma200", "vol30"], R._YEARS, k=50, block_rows=500, test_rows=200))
