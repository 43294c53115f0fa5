"""Probabilities from counts, and what was observed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from barlab.functions.storage import checkpointed

SCORES = (0, 1, 2)


def _ups(alias: str = "ups"):
    return F.sum("target").alias(alias)


def prior_probability(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(ups + 1) / (n + 2) of the matured rows."""
    got = rows.where("target IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _ups())
    return got.select(*keys, "n", "ups", ((F.col("ups") + 1) / (F.col("n") + 2)).alias("probability"))


def regime_probability(rows: DataFrame, keys: list[str], *, shrink: float | None = None) -> DataFrame:
    """Probability by score, for all three scores: (ups + 1) / (n + 2), or with ``shrink`` a: (ups + a * prior) / (n + a)."""
    known = rows.where("target IS NOT NULL")
    prior = prior_probability(known, keys).select(*keys, F.col("probability").alias("prior"))
    grid = prior.withColumn("score", F.explode(F.array(*[F.lit(s) for s in SCORES])))
    got = known.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), _ups())
    both = grid.join(got, [*keys, "score"], "left").fillna(0, ["n", "ups"])
    p = (F.col("ups") + 1) / (F.col("n") + 2) if shrink is None else (F.col("ups") + shrink * F.col("prior")) / (F.col("n") + shrink)
    return both.select(*keys, "score", "n", "ups", p.alias("probability"))


def return_quantiles(rows: DataFrame, keys: list[str], *, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), approximate: bool = False) -> DataFrame:
    """Quantiles of the forward return by score, exact with linear interpolation; approximate ones only if asked."""
    found = F.percentile_approx("forward_return", list(quantiles)) if approximate else F.percentile("forward_return", F.array(*[F.lit(q) for q in quantiles]))
    got = rows.where("forward_return IS NOT NULL").groupBy(*keys, "score").agg(found.alias("q"))
    return got.select(*keys, "score", *[F.get("q", F.lit(i)).alias(f"q{round(100 * q)}") for i, q in enumerate(quantiles)])


def refined_quantiles(rows: DataFrame, keys: list[str], value: str, *, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), cells: int = 1024, most_sent: int = 100_000) -> DataFrame:
    """Exact quantiles with linear interpolation, as F.percentile gives them, from counts: no group is held anywhere.

    The values of rank floor((n - 1) q) and the next one are searched for in
    all groups at once. A pass counts the values of a rank's range in
    ``cells`` equal cells and goes on with the cell that holds the rank, from
    its smallest value to its largest, until these are one value. So a range
    shrinks by ``cells`` at least, and a pass reads only what lies in ranges.
    """
    known = checkpointed(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__x")))
    base = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    place = lambda q: (F.col("__n") - 1) * q
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in quantiles])))
    state = checkpointed(base.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")))
    found = None
    while True:
        done, open_ = state.where("lo = hi"), state.where("lo < hi")
        found = done if found is None else found.unionByName(done)
        count = open_.count()
        if not count:
            break
        met = known.join(F.broadcast(open_) if count <= most_sent else open_, keys).where("__x BETWEEN lo AND hi")
        # halves first: a range wider than the largest double has no width
        cell = F.least(F.floor((F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * cells), F.lit(cells - 1))
        cut = met.groupBy(*keys, "rank", "below", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        line = Window.partitionBy(*keys, "rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        summed = cut.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(line), F.lit(0)))
        state = checkpointed(summed.where("below <= rank AND rank < below + n").select(*keys, "rank", "lo", "hi", "below"))
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("__at"))

    def between(q: float):
        low, high = F.floor(place(q)), F.ceil(place(q))
        a, b = F.element_at("__at", low), F.element_at("__at", high)
        return F.when(low == high, a).otherwise((high - place(q)) * a + (place(q) - low) * b)

    return base.join(values, keys).select(*keys, *[between(q).alias(f"q{round(100 * q)}") for q in quantiles])


def observed_regimes(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where("target IS NOT NULL").groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("up_share"), F.avg("forward_return").alias("mean_return"))


def purged_split(rows: DataFrame, *, start: date, calibration_end: date, evaluation_start: date, evaluation_end: date | None = None) -> DataFrame:
    """``rows`` with ``part``: calibration if the label ends before the calibration does, test from the evaluation's start on; the rest goes."""
    test = F.col("date") >= F.lit(evaluation_start)
    if evaluation_end is not None:
        test = test & (F.col("label_end") < F.lit(evaluation_end))
    fit = (F.col("date") >= F.lit(start)) & (F.col("label_end") < F.lit(calibration_end))
    return rows.withColumn("part", F.when(fit, "calibration").when(test, "test")).where("part IS NOT NULL")


def fold_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and bounds of dates of each fold's training and test."""
    is_in = lambda role, c: F.when(F.col("role") == role, F.col(c))
    return rows.groupBy(*keys, "cutoff").agg(
        F.count(is_in("train", "date")).alias("train_rows"),
        F.count(is_in("test", "date")).alias("test_rows"),
        F.min(is_in("train", "date")).alias("train_start"),
        F.max(is_in("train", "date")).alias("train_end"),
        F.max(is_in("train", "label_end")).alias("train_label_end"),
        F.min(is_in("test", "date")).alias("test_start"),
        F.max(is_in("test", "date")).alias("test_end"),
    )
