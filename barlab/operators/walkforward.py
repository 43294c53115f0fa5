"""Folds in time, counts for all of them at once, and selection from the past."""

from __future__ import annotations

from datetime import date
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


GRID = "id string, family string, window_days int, features string, penalty double, neighbours int"


def candidate_specs(*, windows: tuple[int | None, ...] = (None, 730), penalties: tuple[float, ...] = (0.001, 0.01, 0.1), neighbours: tuple[int, ...] = (25, 75, 150), sets: tuple[str, ...] = ("basic", "expanded", "interactions")) -> list[tuple]:
    """Rows of GRID: all candidates of the search. The defaults are the study's fixed values."""
    rows = [("always_up", "baseline", None, None, None, None), ("historical_prior", "baseline", None, None, None, None)]
    for w in windows:
        tag = "expanding" if w is None else f"{w}d"
        rows.append((f"regime_{tag}", "regime", w, None, None, None))
        rows += [(f"logistic_{s}_{tag}_l2_{p:g}", "logistic", w, s, p, None) for s, p in product(sets, penalties)]
        rows += [(f"knn_{s}_{tag}_k_{k}", "knn", w, s, None, k) for s, k in product(sets, neighbours)]
    return rows


def candidate_grid(spark: SparkSession, **options) -> DataFrame:
    """id, family, window_days, features, penalty, neighbours of all candidates."""
    return spark.createDataFrame(candidate_specs(**options), GRID)


def folds(spark: SparkSession, start: date, stop: date, every: str = "month") -> DataFrame:
    """cutoff and next_cutoff from ``start`` to before ``stop``, monthly or yearly."""
    step = F.expr("interval 1 month" if every == "month" else "interval 1 year")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.date_sub(F.lit(stop), 1), step)).alias("cutoff"))
    return days.select(F.col("cutoff").cast("date"), F.add_months("cutoff", 1 if every == "month" else 12).alias("next_cutoff"))


def expanding_counts(rows: DataFrame, cutoffs: DataFrame, keys: list[str], *, window_days: int | None = None, span: int = 0) -> DataFrame:
    """For each key and cutoff: n and ups of each score among rows with label_end < cutoff.

    Labels and cutoffs are laid on one time line, cutoffs before labels of the
    same day, and summed along it: every fold's counts in one pass, no row
    copied. With ``window_days``, what had matured before the window's first
    label (``span`` days after its date) is subtracted.
    """
    known = rows.where("target IS NOT NULL")
    cells = {}
    for s in (0, 1, 2):
        cells[f"n{s}"] = (F.col("score") == s).cast("long")
        cells[f"ups{s}"] = ((F.col("score") == s) & (F.col("target") == 1)).cast("long")
    labels = known.select(*keys, F.col("label_end").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("cutoff"), *[v.alias(k) for k, v in cells.items()])
    who = known.select(*keys).distinct().crossJoin(F.broadcast(cutoffs.select("cutoff")))
    zero = [F.lit(0).cast("long").alias(k) for k in cells]
    marks = who.select(*keys, F.col("cutoff").alias("ts"), F.lit(0).alias("kind"), "cutoff", *zero)
    line = labels.unionByName(marks)
    if window_days is not None:
        line = line.unionByName(who.select(*keys, F.date_add("cutoff", span - window_days).alias("ts"), F.lit(-1).alias("kind"), "cutoff", *zero))
    w = Window.partitionBy(*keys).orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = line.select(*keys, "kind", "cutoff", *[F.sum(k).over(w).alias(k) for k in cells]).where("kind < 1")
    if window_days is None:
        return summed.drop("kind")
    net = [F.sum(F.when(F.col("kind") == 0, F.col(k)).otherwise(-F.col(k))).alias(k) for k in cells]
    return summed.groupBy(*keys, "cutoff").agg(*net)


def fold_probabilities(counts: DataFrame, *, shrink: float | None = None, least: int = 0) -> DataFrame:
    """``counts`` with train_rows, prior and regime (an array by score), for folds with at least ``least`` rows."""
    n, ups = F.col("n0") + F.col("n1") + F.col("n2"), F.col("ups0") + F.col("ups1") + F.col("ups2")
    prior = (ups + 1) / (n + 2)
    regime = lambda s: (F.col(f"ups{s}") + 1) / (F.col(f"n{s}") + 2) if shrink is None else (F.col(f"ups{s}") + shrink * prior) / (F.col(f"n{s}") + shrink)
    return counts.withColumns({"train_rows": n, "prior": prior, "regime": F.array(*[regime(s) for s in (0, 1, 2)])}).where(F.col("train_rows") >= least)


def predictions(rows: DataFrame, probabilities: DataFrame, keys: list[str], *, every: str = "month") -> DataFrame:
    """Each row with the prior and its score's regime probability of the fold in force on its date."""
    frozen = probabilities.select(*keys, "cutoff", "prior", F.col("regime").alias("__regime"), "train_rows")
    at = rows.withColumn("cutoff", F.trunc("date", every))
    return at.join(frozen, [*keys, "cutoff"]).withColumn("regime", F.get("__regime", F.col("score"))).drop("__regime")


def long_candidates(wide: DataFrame, keys: list[str], candidates: list[str]) -> DataFrame:
    return wide.unpivot([*keys, "date", "label_end", "target"], candidates, "candidate", "probability")


def leaderboard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates by mean yearly accuracy, worst year, pooled Brier score and name; years weigh the same. ``place`` counts from 1.

    Sums of doubles depend on the order of their rows, and would part candidates
    that are equal. So accuracies are decimals (24 digits, their mean 18), and
    losses are summed as decimals of 18 digits: what ties, ties in any order.
    """
    known = rows.where("target IS NOT NULL AND probability IS NOT NULL").withColumns({"right": ((F.col("probability") >= 0.5).cast("int") == F.col("target")).cast("long"), "loss": ((F.col("probability") - F.col("target")) ** 2).cast("decimal(28,18)")})
    yearly = known.groupBy(*keys, "candidate", F.year("date").alias("year")).agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("n"), F.count("loss").alias("finite"), F.sum("loss").alias("loss"))
    shares = yearly.withColumn("accuracy", F.col("right").cast("decimal(23,11)") / F.col("n").cast("decimal(12,0)"))
    brier = F.when(F.sum("finite") == F.sum("n"), F.sum("loss").cast("double") / F.sum("n")).otherwise(float("nan"))  # NaN has no decimal
    got = shares.groupBy(*keys, "candidate").agg(F.sum("n").alias("total"), (F.sum("right") / F.sum("n")).alias("accuracy"), F.avg("accuracy").cast("decimal(20,18)").alias("mean_year_accuracy"), F.min("accuracy").alias("worst_year_accuracy"), brier.alias("brier"))
    order = Window.partitionBy(*keys).orderBy(F.desc("mean_year_accuracy"), F.desc("worst_year_accuracy"), "brier", "candidate")
    return got.withColumn("place", F.row_number().over(order)).withColumns({c: F.col(c).cast("double") for c in ("mean_year_accuracy", "worst_year_accuracy")})


def family_winner(board: DataFrame, families: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate of each family. ``families``: candidate, family."""
    best = Window.partitionBy(*keys, "family").orderBy("place")
    return board.join(F.broadcast(families), "candidate").withColumn("__first", F.row_number().over(best)).where(F.col("__first") == 1).drop("__first")


def select_from_past(rows: DataFrame, outer: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each outer cutoff the candidate of the least mean yearly Brier score among outcomes known before it; ties to the one declared first.

    ``outer``: cutoff, a row per outer year. ``order``: the candidates that may be selected.
    """
    known = rows.where(F.col("candidate").isin(order) & F.col("target").isNotNull() & F.col("probability").isNotNull())
    past = known.join(F.broadcast(outer.select("cutoff")), F.col("label_end") < F.col("cutoff"))
    yearly = past.groupBy(*keys, "cutoff", "candidate", F.year("date").alias("year")).agg(F.avg((F.col("probability") - F.col("target")) ** 2).alias("brier"), F.count(F.lit(1)).alias("n"))
    priority = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("candidate"))
    means = yearly.groupBy(*keys, "cutoff", "candidate").agg(F.avg("brier").alias("mean_annual_brier"), F.sum("n").alias("validation_rows")).withColumn("priority", priority)
    best = Window.partitionBy(*keys, "cutoff").orderBy("mean_annual_brier", "priority")
    return means.withColumn("__first", F.row_number().over(best)).where(F.col("__first") == 1).select(*keys, "cutoff", F.col("candidate").alias("selected"), "mean_annual_brier", "validation_rows")


def nested_predictions(rows: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Each outer year's rows with the probability of the candidate selected for it."""
    chosen = selection.select(*keys, F.year("cutoff").alias("year"), F.col("selected").alias("candidate"))
    return rows.withColumn("year", F.year("date")).join(chosen, [*keys, "year", "candidate"])


def current_freeze(probabilities: DataFrame, selection: DataFrame, keys: list[str], fits: DataFrame | None = None, *, names: tuple[str, ...] = ()) -> DataFrame:
    """The last fold's parameters with the interval in which they hold, and the candidate selected last.

    ``selection``: select_from_past. ``fits``: logistic_folds of the features
    ``names``; with them the artifact also holds what the fitted candidates need.
    """
    newest = probabilities.groupBy(*keys).agg(F.max_by(F.struct("cutoff", "train_rows", "prior", "regime"), "cutoff").alias("x"))
    frozen = newest.select(*keys, F.col("x.cutoff").alias("refit_date"), F.add_months("x.cutoff", 1).alias("valid_until"), "x.train_rows", F.col("x.prior").alias("probability"), F.map_from_arrays(F.array(F.lit(0), F.lit(1), F.lit(2)), "x.regime").alias("regime_probabilities"))
    last = selection.groupBy(*keys).agg(F.max_by("selected", "cutoff").alias("selected"), F.max("cutoff").alias("selection_date"))
    out = frozen.join(last, keys, "left")
    if fits is None:
        return out
    fitted = fits.select(*keys, F.col("cutoff").alias("refit_date"), "train_label_end", "center", "scale", "coefficients")
    return out.join(fitted, [*keys, "refit_date"], "left").withColumn("feature_names", F.array(*[F.lit(c) for c in names]))


def phase(dev_years: tuple[int, ...], dev_end: date) -> Column:
    """development for rows of those years whose labels end before ``dev_end``, reuse from ``dev_end`` on, else null."""
    return F.when(F.year("date").isin(*dev_years) & (F.col("label_end") < F.lit(dev_end)), "development").when(F.col("date") >= F.lit(dev_end), "reuse")
