"""Scores of probabilities: confusion, Brier, log loss, AUC, reliability, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.functions.windows import ratio



def classify(p: str | Column = "probability") -> Column:
    return ((F.col(p) if isinstance(p, str) else p) >= 0.5).cast("int")


def metric_columns(p: str = "probability", y: str = "target") -> list[Column]:
    """Aggregates over rows with a probability and a known target."""
    hat, obs = classify(p), F.col(y)
    count = lambda c: F.count_if(c)
    tp, tn, fp, fn = count((hat == 1) & (obs == 1)), count((hat == 0) & (obs == 0)), count((hat == 1) & (obs == 0)), count((hat == 0) & (obs == 1))
    clipped = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col(p)))
    return [
        F.count(F.lit(1)).alias("total"),
        tp.alias("tp"),
        tn.alias("tn"),
        fp.alias("fp"),
        fn.alias("fn"),
        F.avg((hat == obs).cast("double")).alias("accuracy"),
        ratio(tp, tp + fn).alias("up_recall"),
        ratio(tn, tn + fp).alias("down_recall"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        F.avg(obs).alias("observed_up"),
        F.avg(hat).alias("predicted_up"),
        F.avg((F.col(p) - obs) ** 2).alias("brier"),
        F.avg(-(obs * F.ln(clipped) + (1 - obs) * F.ln(1 - clipped))).alias("log_loss"),
    ]


def metrics(rows: DataFrame, keys: list[str], *, p: str = "probability", y: str = "target") -> DataFrame:
    return rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(*metric_columns(p, y))


def metrics_by_year(rows: DataFrame, keys: list[str], *, date_col: str = "date") -> DataFrame:
    """Metrics of each year and of all years (year null), in one pass of grouping sets."""
    known = rows.where("probability IS NOT NULL AND target IS NOT NULL").withColumn("year", F.year(date_col))
    sets = [[F.col(k) for k in keys], [F.col(k) for k in [*keys, "year"]]]
    return known.groupingSets(sets, *keys, "year").agg(*metric_columns())


def brier_improvement(rows: DataFrame, keys: list[str], base: str = "baseline", p: str = "probability") -> DataFrame:
    known = rows.where(f"{p} IS NOT NULL AND target IS NOT NULL")
    b = lambda c: F.avg((F.col(c) - F.col("target")) ** 2)
    return known.groupBy(*keys).agg(b(p).alias("brier"), b(base).alias("base_brier"), (b(base) - b(p)).alias("improvement"))


def auc(rows: DataFrame, keys: list[str], *, p: str = "probability") -> DataFrame:
    """Rank AUC with ties at their mean rank; counts by distinct probability are ranked, not rows."""
    known = rows.where(F.col(p).isNotNull() & F.col("target").isNotNull())
    by_p = known.groupBy(*keys, p).agg(F.sum("target").alias("ups"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by_p.withColumn("rank", before + (F.col("n") + 1) / 2)
    ups, downs = F.sum("ups"), F.sum(F.col("n") - F.col("ups"))
    return ranked.groupBy(*keys).agg(ratio(F.sum(F.col("rank") * F.col("ups")) - ups * (ups + 1) / 2, ups * downs).alias("auc"))


def reliability_edges(bins: int = 10) -> list[float]:
    """Multiples of 0.1 as floats, so 0.30000000000000004 is an edge and 0.3 lies below it."""
    return [i * (1 / bins) for i in range(bins)] + [1.0]


def reliability_bins(rows: DataFrame, keys: list[str], *, bins: int = 10) -> DataFrame:
    """Count, mean probability and observed share in [low, high), the last bin closed; empty bins stay."""
    edges = reliability_edges(bins)
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, low double, high double")
    place = F.lit(-1)
    for i, e in enumerate(edges[:-1]):
        place = F.when(F.col("probability") >= e, F.lit(i)).otherwise(place)
    known = rows.where("probability IS NOT NULL AND target IS NOT NULL")
    got = known.withColumn("bin", place).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg("target").alias("observed"))
    return known.select(*keys).distinct().crossJoin(F.broadcast(grid)).join(got, [*keys, "bin"], "left").fillna(0, ["n"])


def nonoverlap_offsets(rows: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Metrics of every horizon-th row, for each offset."""
    known = rows.where("probability IS NOT NULL AND target IS NOT NULL")
    at = (F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1) % horizon
    return known.withColumn("offset", at).groupBy(*keys, "offset").agg(*metric_columns())


def confidence_subsets(rows: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65)) -> DataFrame:
    """Metrics of the rows with max(p, 1 - p) >= t; a threshold that no row reaches keeps a row with total 0."""
    spark = rows.sparkSession
    t = spark.createDataFrame([(x,) for x in thresholds], "threshold double")
    known = rows.where("probability IS NOT NULL AND target IS NOT NULL").withColumn("sure", F.greatest("probability", 1 - F.col("probability")))
    all_rows = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("of"))
    met = known.join(F.broadcast(t), F.col("sure") >= F.col("threshold")).groupBy(*keys, "threshold").agg(*metric_columns())
    grid = all_rows.crossJoin(F.broadcast(t)).join(met, [*keys, "threshold"], "left").fillna(0, ["total", "tp", "tn", "fp", "fn"])
    return grid.withColumn("coverage", F.col("total") / F.col("of")).drop("of")


def model_comparison(rows: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Metrics of each candidate beside those of the baseline on the same dates. ``rows``: long, with candidate."""
    base = rows.where(F.col("candidate") == baseline).select(*keys, "date", F.col("probability").alias("base_probability"))
    paired = rows.where("target IS NOT NULL AND probability IS NOT NULL").join(base, [*keys, "date"])
    b = lambda c: F.avg((F.col(c) - F.col("target")) ** 2)
    right = lambda c: F.avg((classify(c) == F.col("target")).cast("double"))
    return paired.groupBy(*keys, "candidate").agg(F.count(F.lit(1)).alias("total"), right("probability").alias("accuracy"), right("base_probability").alias("base_accuracy"), b("probability").alias("brier"), (b("base_probability") - b("probability")).alias("brier_improvement"))


def ci_envelope(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest and highest bound over the block lengths."""
    return intervals.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))


