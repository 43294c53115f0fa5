"""Validation of bars: reject reasons, duplicates, gaps, segments, fingerprints."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from barlab.functions.windows import by_symbol, running
from barlab.sources.files import DAY_MS


def violations(bars: DataFrame, *, as_of: date | None = None, fields: int | None = None) -> DataFrame:
    """``bars`` with ``reasons``: the names of the rules that a row breaks, none for a good row.

    A value that was no finite number has become null in reading. A column
    ``malformed`` (files.read_bars_csv) holds lines with a wrong number of fields.
    """
    prices = ["open", "high", "low", "close"]
    missing = lambda c: F.when(F.col(c).isNull(), F.lit(f"{c}_not_numeric"))
    rules = [F.when(F.col("date").isNull(), F.lit("bad_date")), *[missing(c) for c in [*prices, "volume"]]]
    rules += [F.when(F.least(*prices) <= 0, F.lit("price_not_positive")), F.when(F.col("volume") < 0, F.lit("volume_negative"))]
    rules += [F.when(F.col("high") < F.greatest("open", "close", "low"), F.lit("high_too_low")), F.when(F.col("low") > F.least("open", "close", "high"), F.lit("low_too_high"))]
    if as_of is not None:
        rules.append(F.when(F.col("date") >= F.lit(as_of), F.lit("not_closed")))
    if fields is not None:
        rules.append(F.when(F.col("raw_fields") < fields, F.lit("too_few_fields")))
    if "malformed" in bars.columns:
        rules.append(F.when(F.col("malformed").isNotNull(), F.lit("wrong_column_count")))
    return bars.withColumn("reasons", F.array_compact(F.array(*rules)))


def clean(bars: DataFrame, **options) -> DataFrame:
    return violations(bars, **options).where(F.size("reasons") == 0).drop("reasons")


def rejects(bars: DataFrame, **options) -> DataFrame:
    return violations(bars, **options).where(F.size("reasons") > 0)


def duplicate_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def gap_report(bars: DataFrame) -> DataFrame:
    """Each gap: the bars around it and the number of days missing."""
    days = bars.select("symbol", "date").distinct().withColumn("before", F.lag("date").over(by_symbol()))
    return days.where(F.datediff("date", "before") > 1).select("symbol", "before", F.col("date").alias("after"), (F.datediff("date", "before") - 1).alias("missing"))


def missing_dates(bars: DataFrame) -> DataFrame:
    """Days inside gaps; each gap is unfolded where it is found."""
    return gap_report(bars).select("symbol", F.explode(F.sequence(F.date_add("before", 1), F.date_sub("after", 1))).alias("date"))


def contiguous_segments(bars: DataFrame) -> DataFrame:
    """``bars`` with ``segment``, counted from 0 in each symbol; windows by symbol and segment never bridge a gap."""
    step = F.coalesce((F.datediff("date", F.lag("date").over(by_symbol())) > 1).cast("int"), F.lit(0))
    return bars.withColumn("__gap", step).withColumn("segment", F.sum("__gap").over(running())).drop("__gap")


def closed_only(klines: DataFrame, reference_ms: int) -> DataFrame:
    """Bars whose day is over at the reference time (a day that ends just then counts as over); future or misaligned ones are errors."""
    checked = klines.withColumn(
        "__bad",
        F.when(F.col("open_ms") > reference_ms, F.lit("opens in the future"))
        .when(F.col("open_ms") % DAY_MS != 0, F.lit("open is not a midnight"))
        .when(F.col("close_ms") != F.col("open_ms") + DAY_MS - 1, F.lit("close is not the day's end")),
    )
    guarded = checked.where(F.when(F.col("__bad").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("__bad")).cast("boolean")))
    return guarded.where(F.col("open_ms") + DAY_MS <= reference_ms).drop("__bad")


def manifest(bars: DataFrame, source: str = "") -> DataFrame:
    """Rows, first and last bar and a fingerprint of each symbol's bars: the exact sum of the rows' hashes, so the order does not count, but a repeated row does."""
    h = F.xxhash64("date", "open", "high", "low", "close", "volume").cast("decimal(38,0)")
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.sum(h).alias("fingerprint")).withColumn("source", F.lit(source))


def manifest_diff(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Symbols whose bars are not those of a frozen manifest, with what differs; data may be used only if there are none."""
    return dataset_diff(frozen.drop("source"), now.drop("source"), ["symbol"])


def coverage(bars: DataFrame, *, least: int = 201, most: int = 20_000, reach: date, yesterday: date) -> DataFrame:
    """Whether each symbol has enough bars, not too many, reaches the evaluation, and is up to date."""
    got = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("date").alias("last_bar"))
    return got.select(
        "symbol",
        "rows",
        "last_bar",
        F.col("rows").between(least, most).alias("size_ok"),
        (F.col("last_bar") >= F.lit(reach)).alias("reaches"),
        F.datediff(F.lit(yesterday), "last_bar").alias("stale_days"),
        (F.datediff(F.lit(yesterday), "last_bar") > 0).alias("stale"),
    )


def dataset_diff(a: DataFrame, b: DataFrame, keys: list[str], *, tolerance: float = 0.0) -> DataFrame:
    """Rows that one side lacks or whose numbers differ by more than ``tolerance``: keys and ``what``."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*values).alias("x"), F.lit(1).alias("in_a"))
    right = b.select(*keys, F.struct(*values).alias("y"), F.lit(1).alias("in_b"))
    numeric = {f.name for f in a.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")}

    def differs(c: str):
        x, y = F.col(f"x.{c}"), F.col(f"y.{c}")
        near = (F.abs(x - y) <= tolerance) | (x.isNull() & y.isNull()) if c in numeric else x.eqNullSafe(y)
        return F.when(~F.coalesce(near, F.lit(False)), F.lit(c))

    both = left.join(right, keys, "full_outer")
    found = F.when(F.col("in_b").isNull(), F.array(F.lit("missing_in_b"))).when(F.col("in_a").isNull(), F.array(F.lit("missing_in_a"))).otherwise(F.array_compact(F.array(*[differs(c) for c in values])))
    return both.select(*keys, found.alias("what")).where(F.size("what") > 0)


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """Number of rows and exact sum of their hashes for each value of ``by``."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("__sum"))


def differing_days(a: DataFrame, b: DataFrame, keys: list[str], *, date_col: str = "date") -> DataFrame:
    """Keys and days on which two tables do not hold the same rows, by fingerprints: of months first, and of the days of differing months then.

    Equal parts cost a hash a row and a row a month; nothing of them is joined.
    """
    other = [k for k in keys if k != date_col]

    def differ(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
        both = fingerprints(x, by).alias("x").join(fingerprints(y, by).alias("y"), [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by], "full_outer")
        same = F.col("x.__rows").eqNullSafe(F.col("y.__rows")) & F.col("x.__sum").eqNullSafe(F.col("y.__sum"))
        return both.where(~same).select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in by])

    monthly = lambda t: t.select(*sorted(t.columns), F.trunc(date_col, "month").alias("__month"))
    x, y = monthly(a), monthly(b.select(*a.columns))
    months = differ(x, y, [*other, "__month"])
    inside = lambda t: t.join(months, [*other, "__month"], "left_semi")
    return differ(inside(x), inside(y), [*other, date_col])


def dataset_diff_by_fingerprints(a: DataFrame, b: DataFrame, keys: list[str], *, date_col: str = "date", tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """dataset_diff of the days that differ, and these days' rows in ``a``: what had to be compared."""
    days = differing_days(a, b, keys, date_col=date_col)
    on = [k for k in keys if k != date_col] + [date_col]
    some = lambda t: t.join(days, on, "left_semi")
    return dataset_diff(some(a), some(b.select(*a.columns)), keys, tolerance=tolerance), some(a)
