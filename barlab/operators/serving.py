"""Which frozen probability applies to a date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from barlab.functions.windows import by_symbol, ratio
from barlab.operators import calibration, labels
from barlab.operators.quality import dataset_diff


def calibration_record(rows: DataFrame) -> DataFrame:
    """symbol, score, probability, n, baseline, q10, q50 and q90 of matured calibration rows: what a forecast shows."""
    keys = ["symbol"]
    base = calibration.prior_probability(rows, keys).select("symbol", F.col("probability").alias("baseline"))
    shares = calibration.regime_probability(rows, keys).select("symbol", "score", "probability", "n")
    return shares.join(base, keys).join(calibration.return_quantiles(rows, keys), ["symbol", "score"], "left")


def forecast(ind: DataFrame, table: DataFrame, horizon: int, *, lag: int = 2, start: date, horizons: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Frozen calibration of each scored bar from ``start`` on, entry and end dates, direction, and the return if it is known.

    ``table``: symbol, score, probability and what else the calibration holds
    (calibration_record), all of it handed on. The bars of entry and exit are
    counted, not looked up by date.
    """
    if horizon not in horizons:
        raise ValueError(f"no such horizon: {horizon}")
    w = by_symbol()
    got = ind.withColumn("realized", ratio(F.lead("open", lag + horizon).over(w), F.lead("open", lag).over(w)) - 1)
    known = got.where(F.col("score").isNotNull() & (F.col("date") >= F.lit(start)))
    joined = labels.score_probability(known, table, ["symbol"])
    return joined.select(
        "symbol",
        "date",
        F.lit(horizon).alias("horizon"),
        "score",
        *[c for c in table.columns if c not in ("symbol", "score")],
        F.date_add("date", lag).alias("entry_date"),
        F.date_add("date", lag + horizon).alias("end_date"),
        F.when(F.col("probability") >= 0.5, "up").when(F.col("probability").isNotNull(), "not_up").alias("direction"),
        "realized",
    )


def research_forecast(bars: DataFrame, oos: DataFrame, artifacts: DataFrame, horizon: int, *, history: bool = True) -> DataFrame:
    """Stored out-of-sample probability, else the valid frozen prior, else a reason why there is none."""
    found = labels.oos_lookup(bars.select("symbol", "date", "close"), oos, artifacts, ["symbol"], history=history)
    served = (F.col("mode") == "historical") | ((F.col("mode") == "frozen") & (F.col("selected") == "historical_prior"))
    valid = F.col("probability").between(0.0, 1.0) & ~F.isnan("probability")
    reason = F.when(F.col("mode") == "unavailable", "no frozen model is valid on this date").when(~served, "the selected candidate cannot be served").when(~F.coalesce(valid, F.lit(False)), "the probability is not valid")
    out = found.withColumns({"reason": reason, "probability": F.when(reason.isNull(), F.col("probability")), "mode": F.when(reason.isNull(), F.col("mode")).otherwise("unavailable")})
    ended = labels.realized_close(out, bars, horizon)
    return ended.select("symbol", "date", F.lit(horizon).alias("horizon"), "mode", "probability", "reason", F.date_add("date", horizon).alias("end_date"), "realized")


def outcome_status(forecasts: DataFrame, as_of: date) -> DataFrame:
    """immature before the end date, missing if bars for it are not there, else right or wrong."""
    up = F.col("realized") > 0
    status = F.when(F.col("end_date") > F.lit(as_of), "immature").when(F.col("realized").isNull(), "missing").when(up == (F.col("probability") >= 0.5), "right").otherwise("wrong")
    return forecasts.withColumn("status", status)


def reproduce(stored: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Where recomputed results differ from stored ones."""
    return dataset_diff(stored, recomputed, keys, tolerance=tolerance)


def leaks(before: DataFrame, after: DataFrame, keys: list[str], cutoff: date, tolerance: float = 0.0) -> DataFrame:
    """Rows up to ``cutoff`` that changed when only later bars were removed or altered; none may."""
    upto = lambda df: df.where(F.col("date") <= F.lit(cutoff))
    return dataset_diff(upto(before), upto(after), keys, tolerance=tolerance)


def study_leaks(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: list[str], cutoff: date, tolerance: float = 1e-12) -> DataFrame:
    """leaks for every part of a study at once (features, fits, predictions, selections): keys, part and what changed."""
    found = [leaks(before[part], after[part], keys, cutoff, tolerance).select(*keys, F.lit(part).alias("part"), F.concat_ws(",", "what").alias("what")) for part in before]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def fold_leaks(rows: DataFrame) -> DataFrame:
    """Training rows whose label was not yet known at the refit; none may be."""
    return rows.where((F.col("role") == "train") & (F.col("label_end") >= F.col("cutoff")))
