"""Forward returns, and joins of signals with tables of folds, models and outcomes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.windows import by_symbol, ratio


def _labelled(bars: DataFrame, value: Column, days: int) -> DataFrame:
    got = bars.withColumns({"forward_return": value, "label_end": F.date_add("date", days)})
    return got.withColumn("target", (F.col("forward_return") > 0).cast("int"))


def open_to_open(bars: DataFrame, horizon: int, lag: int = 2) -> DataFrame:
    """Return from the open ``lag`` bars on to the open ``horizon`` bars later; the target is null until that is known."""
    w = by_symbol()
    return _labelled(bars, ratio(F.lead("open", lag + horizon).over(w), F.lead("open", lag).over(w)) - 1, lag + horizon)


def close_to_close(bars: DataFrame, horizon: int) -> DataFrame:
    return _labelled(bars, ratio(F.lead("close", horizon).over(by_symbol()), F.col("close")) - 1, horizon)


def dataset(labelled: DataFrame, features: list[str], *, start: date, matured: bool = True) -> DataFrame:
    """Rows from ``start`` on whose features (and label, unless unmatured ones are asked for) are all known; one that is not finite is an error."""
    numbers = [*features, "forward_return"] if matured else list(features)
    known = labelled.where(F.col("date") >= F.lit(start)).dropna(subset=[*numbers, *(["target"] if matured else [])])
    doubles = [c for c in numbers if dict(labelled.dtypes)[c] in ("double", "float")]
    wrong = [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in doubles]
    bad = F.lit(False)
    for x in wrong:
        bad = bad | x
    return known.where(F.when(bad, F.raise_error(F.lit("a feature is not finite")).cast("boolean")).otherwise(F.lit(True)))


def next_open_return() -> Column:
    return ratio(F.lead("open").over(by_symbol()), F.col("open")) - 1


def execution_lag(weights: DataFrame, strategies: list[str], lag: int, *, start: date, stop: date) -> DataFrame:
    """Weights decided ``lag`` bars before, on the days of [start, stop) that have a next open and all strategies' weights."""
    w = by_symbol()
    lagged = weights.select("symbol", "date", "next_return", *[F.lag(s, lag).over(w).alias(s) for s in strategies])
    return lagged.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(stop))).dropna(subset=["next_return", *strategies])


def score_probability(signals: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each signal with the frozen probability of its score."""
    return signals.join(table, [*keys, "score"], "left")


def paired_versions(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, target, probability and ``other`` (the second's) of two model versions' predictions of the same outcomes.

    A row that one of them lacks, or a target that differs, is an error: the
    versions would be scored on different things.
    """
    other = second.select(*keys, F.col("target").alias("__target"), F.col("probability").alias("other"), F.lit(True).alias("__there"))
    both = first.withColumn("__here", F.lit(True)).join(other, keys, "full_outer")
    name = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    wrong = F.when(F.col("__here").isNull() | F.col("__there").isNull(), F.concat(F.lit("only one version has "), name)).when(~F.col("target").eqNullSafe(F.col("__target")), F.concat(F.lit("the versions' targets differ on "), name))
    fine = F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))
    return both.where(fine).select(*keys, "target", "probability", "other")


def folds_of(rows: DataFrame, folds: DataFrame, *, window_days: int | None = None) -> DataFrame:
    """Rows by the fold that they train (``role`` train: label_end < cutoff) or test (cutoff <= date < next cutoff).

    ``folds``: cutoff, next_cutoff; a row per refit date of the protocol, sent to every task.
    """
    f = F.broadcast(folds)
    train = rows.join(f, F.col("label_end") < F.col("cutoff"))
    if window_days is not None:
        train = train.where(F.col("date") >= F.date_sub("cutoff", window_days))
    test = rows.join(f, (F.col("date") >= F.col("cutoff")) & (F.col("date") < F.col("next_cutoff")))
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))


def as_of_model(signals: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Each signal with the artifact valid on its date (refit_date <= date < valid_until), or none.

    Signals and artifacts lie on one time line of a key, artifacts first, and
    the last artifact is carried along it: no signal meets the others. Two
    artifacts of a key that hold on the same day are an error.
    """
    rest = [c for c in artifacts.columns if c not in keys]
    line = Window.partitionBy(*keys).orderBy("__at", "__kind")
    before = F.max("valid_until").over(Window.partitionBy(*keys).orderBy("refit_date").rowsBetween(Window.unboundedPreceding, -1))
    overlap = F.coalesce(before > F.col("refit_date"), F.lit(False))
    guarded = F.when(overlap, F.raise_error(F.concat(F.lit("two artifacts hold on "), F.col("refit_date").cast("string"))).cast("date")).otherwise(F.col("refit_date"))
    model = artifacts.select(*keys, guarded.alias("__at"), F.lit(0).alias("__kind"), F.struct(*rest).alias("__model"))
    asked = signals.select(*keys, F.col("date").alias("__at"), F.lit(1).alias("__kind"), F.struct(*signals.columns).alias("__signal"))
    both = model.unionByName(asked, allowMissingColumns=True)
    carried = F.last("__model", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__model", carried).where("__kind = 1")
    valid = F.when(F.col("__at") < F.col("__model.valid_until"), F.col("__model"))
    return found.withColumn("__model", valid).select("__signal.*", *[F.col(f"__model.{c}").alias(c) for c in rest])


def oos_lookup(signals: DataFrame, oos: DataFrame, artifacts: DataFrame, keys: list[str], *, history: bool = True) -> DataFrame:
    """The stored out-of-sample probability of exactly that date where history is allowed, else the valid artifact's; ``mode`` says which."""
    with_model = as_of_model(signals, artifacts.withColumnRenamed("probability", "frozen_probability"), keys)
    stored = oos.select(*keys, "date", F.col("probability").alias("stored_probability"))
    both = with_model.join(stored, [*keys, "date"], "left")
    use = F.col("stored_probability").isNotNull() & F.lit(history)
    mode = F.when(use, "historical").when(F.col("frozen_probability").isNotNull(), "frozen").otherwise("unavailable")
    return both.withColumns({"mode": mode, "probability": F.when(use, F.col("stored_probability")).otherwise(F.col("frozen_probability"))})


def realized_close(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Return to the close of exactly ``horizon`` days later; null if there is no such bar."""
    later = bars.select("symbol", F.date_sub("date", horizon).alias("date"), F.col("close").alias("__later"))
    return signals.join(later, ["symbol", "date"], "left").withColumn("realized", ratio(F.col("__later"), F.col("close")) - 1).drop("__later")
