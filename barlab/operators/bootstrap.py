"""Circular block bootstrap on prefix sums.

A resample's sum is the sum of its blocks, and a block's sum is a difference
of two prefix sums, so a repetition costs n / block look-ups, not n. A series
becomes one row with its prefix sums as arrays (n is a series' length, which
fits a row); all repetitions and block lengths are worked out in that row.
Starts are hashes of (seed, repetition, block), the same in every run and
engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def block_start(seed: int, rep: Column, block_no: Column, n: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), block_no.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def circular_blocks(lengths: DataFrame, keys: list[str], *, block: int, reps: int, seed: int) -> DataFrame:
    """keys, n, rep, block_no, start, size for series of length n; the last block is cut to n in total."""
    blocks = F.ceil(F.col("n") / block)
    grid = lengths.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("block_no", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    size = F.least(F.lit(block), F.col("n") - F.col("block_no") * block)
    return grid.select(*keys, "n", "rep", "block_no", block_start(seed, F.col("rep"), F.col("block_no"), F.col("n")).alias("start"), size.cast("long").alias("size"))


def resampled_sums(rows: DataFrame, keys: list[str], values: list[str], *, block: int | tuple[int, ...], reps: int, seed: int, order: str = "date") -> DataFrame:
    """keys, block (length), rep, n and the sum of each value in each resample; all values use the same (paired) blocks."""
    lengths = (block,) if isinstance(block, int) else block
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select(*keys, F.col(order).alias("__at"), *[F.sum(F.col(v).cast("double")).over(upto).alias(v) for v in values])
    series = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", *values))).alias("__rows"), F.count(F.lit(1)).alias("n"))
    prefix = series.select(*keys, "n", *[F.concat(F.array(F.lit(0.0)), F.col(f"__rows.{v}")).alias(f"__{v}") for v in values])
    each = prefix.withColumn("block", F.explode(F.array(*[F.lit(b) for b in lengths])))
    n, zero = F.col("n"), F.lit(0).cast("long")

    def place(rep: Column, number: Column) -> Column:
        start = block_start(seed, rep, number, n)
        end = start + F.least(F.col("block"), n - number * F.col("block"))
        return F.struct(start.alias("s"), F.least(end, n).alias("e"), F.greatest(end - n, zero).alias("over"))

    def resample(rep: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), (F.ceil(n / F.col("block")) - 1).cast("int")), lambda number: place(rep, number))
        at = lambda v, i: F.get(F.col(f"__{v}"), i.cast("int"))
        total = lambda found, v: F.aggregate(found, F.lit(0.0), lambda t, x: t + at(v, x["e"]) - at(v, x["s"]) + at(v, x["over"]))
        return F.get(F.transform(F.array(places), lambda found: F.struct(rep.alias("rep"), *[total(found, v).alias(v) for v in values])), F.lit(0))

    found = each.select(*keys, "block", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), resample)).alias("x"))
    return found.select(*keys, "block", "n", "x.*")


def _intervals(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    q = F.percentile("__v", F.array(F.lit(0.025), F.lit(0.975)))
    got = df.withColumn("__v", value).groupBy(*keys, "block").agg(q.alias("q"), F.count("__v").alias("reps"))
    return got.select(*keys, "block", "reps", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def mean_intervals(rows: DataFrame, keys: list[str], value: str, *, blocks: tuple[int, ...], reps: int, seed: int, order: str = "date") -> DataFrame:
    """95 % interval of the mean of ``value``, for each block length."""
    return _intervals(resampled_sums(rows, keys, [value], block=blocks, reps=reps, seed=seed, order=order), keys, F.col(value) / F.col("n"))


def paired_uncertainty(rows: DataFrame, keys: list[str], *, blocks: tuple[int, ...], reps: int, seed: int, baseline: str = "prior", order: str = "date") -> DataFrame:
    """keys, block, reps and 95 % intervals of accuracy, accuracy gain and Brier gain over ``baseline``, from the same resamples.

    ``rows``: target, probability and the baseline's probability.
    """
    right = lambda c: ((F.col(c) >= 0.5).cast("int") == F.col("target")).cast("double")
    miss = lambda c: (F.col(c) - F.col("target")) ** 2
    values = {"accuracy": right("probability"), "accuracy_gain": right("probability") - right(baseline), "brier_gain": miss(baseline) - miss("probability")}
    sums = resampled_sums(rows.withColumns(values), keys, list(values), block=blocks, reps=reps, seed=seed, order=order)
    q = lambda v: F.percentile(F.col(v) / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias(v)
    got = sums.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("reps"), *[q(v) for v in values])
    ends = [F.get(v, F.lit(i)).alias(f"{v}_{end}") for v in values for i, end in enumerate(("low", "high"))]
    return got.select(*keys, "block", "reps", *ends)


def sharpe_difference(rows: DataFrame, keys: list[str], a: str, b: str, *, blocks: tuple[int, ...], reps: int, seed: int, annual: int = 365, order: str = "date") -> DataFrame:
    """95 % interval of Sharpe(a) - Sharpe(b) on paired resamples, for each block length; a resample without variance has Sharpe 0."""
    squares = rows.withColumns({"__aa": F.col(a) * F.col(a), "__bb": F.col(b) * F.col(b)})

    def sharpe(s: str, ss: str) -> Column:
        n = F.col("n")
        var = (F.col(ss) - F.col(s) * F.col(s) / n) / (n - 1)
        return F.when(var > 1e-18, F.col(s) / n * F.sqrt(F.lit(float(annual))) / F.sqrt(var)).otherwise(0.0)

    return _intervals(resampled_sums(squares, keys, [a, b, "__aa", "__bb"], block=blocks, reps=reps, seed=seed, order=order), keys, sharpe(a, "__aa") - sharpe(b, "__bb"))


def evidence_gate(intervals: DataFrame, yearly: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all lower bounds (``low``) are above 0 and no year's Brier score is above its prior's.

    ``intervals``: of the accuracy and the Brier gain, for each horizon and
    block length; ``yearly``: for each horizon and year. All rows of a key
    must pass.
    """
    certain = intervals.groupBy(*keys).agg(F.every(F.col("low") > 0).alias("certain"))
    no_worse = yearly.groupBy(*keys).agg(F.every(F.col("brier") <= F.col("prior_brier")).alias("no_year_worse"))
    return certain.join(no_worse, keys).withColumn("evidence", F.col("certain") & F.col("no_year_worse"))


def primary_goal(overall: DataFrame, yearly: DataFrame, intervals: DataFrame, keys: list[str], accuracy: float = 0.9) -> DataFrame:
    """Accuracy above the goal at full coverage, in each year, and at each interval's lower bound."""
    a = overall.select(*keys, ((F.col("accuracy") > accuracy) & (F.col("coverage") == 1)).alias("achieved"))
    b = yearly.groupBy(*keys).agg(F.every(F.col("accuracy") > accuracy).alias("every_year"))
    c = intervals.groupBy(*keys).agg(F.every(F.col("low") > accuracy).alias("every_bound"))
    return a.join(b, keys).join(c, keys)
