"""Reading and writing bars, quotes and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from barlab.schemas import BAR_COLUMNS

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DAY_MS = 86_400_000
_MALFORMED = "__malformed"


def number(text: Column) -> Column:
    """A decimal number with an optional exponent; null for anything else, also hexadecimal, blank and infinite."""
    trimmed = F.trim(text)
    value = F.when(F.rlike(trimmed, F.lit(NUMBER)), trimmed.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def read_klines(rows: DataFrame, *, payload: str = "value", symbol: str = "symbol") -> DataFrame:
    """Bars from JSON arrays of arrays: open time (ms), open, high, low, close, volume as strings, close time, ...

    One row for each inner array, with ``raw_fields`` (how many it had) and
    ``open_ms``, ``close_ms``; values that are no numbers are null. A page that
    is no such array, or an empty one, gives a row of nulls with 0 fields, so
    that quality.violations (``fields``: how many there must be) reports it.
    """
    found = rows.select(F.col(symbol).alias("symbol"), F.explode_outer(F.from_json(payload, "array<array<string>>")).alias("k"))
    at = lambda i: F.get("k", F.lit(i))
    ms = lambda i: at(i).try_cast("bigint")
    return found.select(
        "symbol",
        F.to_date(F.timestamp_millis(ms(0))).alias("date"),
        *[number(at(i)).alias(c) for i, c in enumerate(BAR_COLUMNS[2:], 1)],
        ms(0).alias("open_ms"),
        ms(6).alias("close_ms"),
        F.coalesce(F.size("k"), F.lit(0)).alias("raw_fields"),
    )


def merge_pages(*pages: DataFrame) -> DataFrame:
    """Pages of klines one after the other; quality.duplicate_dates and quality.gap_report find overlaps and gaps between them."""
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


def page_borders(*pages: DataFrame) -> DataFrame:
    """Borders between one symbol's pages at which bars overlap or are missing: symbol, page (from 1), problem, days."""
    spans = [p.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last")).withColumn("page", F.lit(i)) for i, p in enumerate(pages)]
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    before = F.max("last").over(Window.partitionBy("symbol").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    days = F.datediff("first", before) - 1
    return out.withColumn("days", days).where("days <> 0").select("symbol", "page", F.when(F.col("days") > 0, "gap").otherwise("overlap").alias("problem"), F.abs("days").alias("days"))


def joined_pages(*pages: DataFrame) -> DataFrame:
    """merge_pages, but a gap or an overlap between pages is an error."""
    wrong = page_borders(*pages).agg(F.max(F.concat_ws(" ", "problem", F.lit("before page"), "page", F.lit("of"), "symbol")).alias("__wrong"))
    fine = F.when(F.col("__wrong").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("__wrong")).cast("boolean"))
    return merge_pages(*pages).crossJoin(F.broadcast(wrong)).where(fine).drop("__wrong")


def read_bars_csv(spark: SparkSession, path: str, *, symbol: str | None = None) -> DataFrame:
    """Typed bars of a CSV with a header in any case and order, and ``malformed``: the line, where it has too many or too few fields, else null.

    Further columns are ignored, blank lines skipped. quality.rejects reports
    a malformed line as wrong_column_count and bad values by their rules; what
    can be read of such a line is there.
    """
    options = {"header": True, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _MALFORMED]])
    raw = spark.read.options(**options, columnNameOfCorruptRecord=_MALFORMED, columnPruning=False).schema(schema).csv(path)
    return bars_from_strings(raw, symbol=symbol)


def bars_from_strings(raw: DataFrame, *, symbol: str | None = None) -> DataFrame:
    """Typed bars from string columns, found by name; a column that is missing is an error, a bad value null."""
    headers = [c.strip().lstrip("﻿").lower() for c in raw.columns]
    twice = sorted({h for h in headers if h in BAR_COLUMNS and headers.count(h) > 1})
    if twice:
        raise ValueError(f"columns occur twice: {twice}")
    names = dict(zip(headers, raw.columns))
    missing = [c for c in BAR_COLUMNS[1:] if c not in names]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    col = lambda c: F.col(f"`{names[c]}`")
    who = F.lit(symbol) if symbol is not None else col("symbol") if "symbol" in names else F.lit("")
    day = F.when(F.rlike(F.trim(col("date")), F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date(F.trim(col("date")), "yyyy-MM-dd"))
    line = [F.col(_MALFORMED).alias("malformed")] if _MALFORMED in raw.columns else []
    return raw.select(who.alias("symbol"), day.alias("date"), *[number(col(c)).alias(c) for c in BAR_COLUMNS[2:]], *line)


def read_quotes(rows: DataFrame, *, payload: str = "value", wanted: str | None = None, received_at: str = "received_at") -> DataFrame:
    """Quotes {symbol, price} with a finite price above 0, of one symbol if asked."""
    q = F.from_json(payload, "symbol string, price string")
    out = rows.select(q["symbol"].alias("symbol"), number(q["price"]).alias("price"), F.col(received_at).alias("received_at")).where("price > 0 AND symbol IS NOT NULL")
    return out if wanted is None else out.where(F.col("symbol") == wanted)


def write_table(df: DataFrame, path: str, *, form: str = "parquet", by: list[str] | None = None, digits: int | None = None) -> None:
    """Write results; NaN and infinities become null, so that JSON and CSV stay readable anywhere.

    ``by``: a folder for each value of these columns. ``digits``: decimals of
    every number with a fraction, in CSV (all of them) and JSON (rounded).
    """

    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return c
        c = F.when(F.abs(c) < float("inf"), c)
        if digits is not None:
            c = F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)) if form == "csv" else F.round(c, digits) if form == "json" else c
        return c.alias(f.name)

    clean = df.select(*[plain(f) for f in df.schema.fields])
    writer = clean.write.partitionBy(*by) if by else clean.write
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def sample_bars(bars: DataFrame, n: int = 240) -> DataFrame:
    """The last n bars of each symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= n).drop("__rank")


def curve_bundle(daily: DataFrame) -> DataFrame:
    """Points of each strategy's curve: (first execution date, 1, 0), then equity and weight at each day's end."""
    keys = [c for c in ("symbol", "scenario", "strategy") if c in daily.columns]
    first = daily.groupBy(*keys).agg(F.min("execution_date").alias("valuation_date")).select(*keys, "valuation_date", F.lit(1.0).alias("equity"), F.lit(0.0).alias("weight"))
    rest = daily.select(*keys, F.date_add("execution_date", 1).alias("valuation_date"), "equity", "weight")
    return first.unionByName(rest)


def curve_json(points: DataFrame) -> DataFrame:
    """One JSON array of points per curve, by date."""
    keys = [c for c in ("symbol", "scenario", "strategy") if c in points.columns]
    return points.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("valuation_date", "equity", "weight")))).alias("payload"))


def signal_export(signals: DataFrame, forecasts: DataFrame, metrics: DataFrame) -> DataFrame:
    """One JSON per symbol and horizon: signal, forecast, and how often such forecasts were right."""
    joined = signals.join(forecasts, "symbol").join(metrics, ["symbol", "horizon"], "left")
    right = F.round(F.col("accuracy") * F.col("total")).cast("long")
    return joined.select("symbol", "horizon", F.to_json(F.struct("date", "score", "probability", "direction", "accuracy", "total", right.alias("correct"))).alias("payload"))
