"""Queries over what was written and read back: CSV with faults, fixed formats, and committed artifacts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.functions.storage import checkpointed
from barlab.jobs import sql as S
from barlab.jobs.panel import index_bars
from barlab.jobs.registry import P, matured, months, query, r6, sel
from barlab.jobs.streams import scratch
from barlab.operators import calibration as cal, labels as lb, quality as ql, scoring as sc, serving as sv, walkforward as wf
from barlab.sources import artifacts as store, files as io

# ---- S5, S2 and D1: files


@query("s5_write_and_read", f"{S.BASE} SELECT symbol, date, round(close, 4) AS close, round(close, 6) AS json_close, true AS same_bars FROM bars")
def s5(spark, d):
    """Bars written as CSV of four decimals with a folder for each symbol, as JSON of six, and as Parquet, and read back."""
    root = scratch(spark, "written")
    b = checkpointed(index_bars(spark, d))
    io.write_table(b, f"{root}/csv", form="csv", by=["symbol"], digits=4)
    io.write_table(b.withColumn("nothing", F.lit(float("nan"))), f"{root}/json", form="json", digits=6)
    io.write_table(b, f"{root}/parquet", by=["symbol"])
    csv = io.read_bars_csv(spark, f"{root}/csv").where("malformed IS NULL").select("symbol", "date", "close")
    js = spark.read.schema("symbol string, date date, close double, nothing double").json(f"{root}/json").where("nothing IS NULL").select("symbol", "date", F.col("close").alias("json_close"))
    altered = ql.dataset_diff(b, spark.read.parquet(f"{root}/parquet").select(*b.columns), ["symbol", "date"]).select("symbol", "date", F.lit(False).alias("same"))
    both = csv.join(js, ["symbol", "date"]).join(altered, ["symbol", "date"], "left")
    return r6(both.withColumn("same_bars", F.coalesce("same", F.lit(True))).drop("same"))


_LINE_FAULTS = "CASE day(date) WHEN 1 THEN 'volume_not_numeric|wrong_column_count' WHEN 2 THEN 'wrong_column_count' WHEN 3 THEN 'open_not_numeric' WHEN 4 THEN 'close_not_numeric' WHEN 5 THEN 'bad_date' WHEN 6 THEN 'volume_negative' WHEN 7 THEN 'high_too_low|low_too_high' WHEN 8 THEN 'volume_not_numeric' WHEN 9 THEN 'price_not_positive' END"


@query("s2_d1_csv_rejects", f"""{S.BASE}, f AS (SELECT symbol, date, {_LINE_FAULTS} AS reasons FROM bars) SELECT symbol, CASE WHEN day(date) <> 5 THEN date END AS date, reasons, 1::BIGINT AS lines FROM f WHERE reasons IS NOT NULL AND day(date) <> 5
UNION ALL SELECT symbol, NULL, 'bad_date', count(*) FROM f WHERE day(date) = 5 GROUP BY 1 UNION ALL SELECT symbol, NULL, 'fine', count(*) FROM f WHERE reasons IS NULL GROUP BY 1""")
def s2d1(spark, d):
    """A CSV with a fault of another kind on each of the first nine days of every month, quoted fields, further columns and blank lines: the rejected lines, and how many are fine."""
    root = scratch(spark, "csv")
    n = F.dayofmonth("date")
    text = {c: F.format_string("%.8f", F.col(c)) for c in ("open", "high", "low", "close", "volume")}
    high, low = F.when(n == 7, text["low"]).otherwise(text["high"]), F.when(n == 7, text["high"]).when(n == 9, F.lit("1e-999")).otherwise(text["low"])
    opened = F.when(n == 3, F.lit("Infinity")).when(n == 10, F.concat(F.lit('"'), text["open"], F.lit('"'))).otherwise(text["open"])
    closed, volume = F.when(n == 4, F.lit("0x1F")).otherwise(text["close"]), F.when(n == 6, F.lit("-1")).when(n == 8, F.lit(" ")).otherwise(text["volume"])
    day = F.when(n == 5, F.lit("2026-02-30")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    fields = F.concat_ws(",", F.lit("note"), closed, "symbol", day, opened, high, low)
    line = F.when(n == 1, fields).when(n == 2, F.concat_ws(",", fields, volume, F.lit("one too many"))).otherwise(F.concat_ws(",", fields, volume))
    lines = index_bars(spark, d).select(F.when(n == 12, F.concat(line, F.lit("\n"))).otherwise(line).alias("value"))
    header = F.lit("Remark,CLOSE,Symbol,date,open,High,low,Volume\n")
    # a header on top of each file, as a writer of CSV gives it
    lines.sortWithinPartitions("value").write.text(f"{root}/body")
    body = spark.read.text(f"{root}/body", wholetext=True)
    body.select(F.concat(header, F.col("value")).alias("value")).write.text(f"{root}/csv")
    found = checkpointed(ql.violations(io.read_bars_csv(spark, f"{root}/csv")).select("symbol", "date", F.concat_ws("|", "reasons").alias("reasons")))
    bad = found.where("reasons <> ''").groupBy("symbol", "date", "reasons").agg(F.count(F.lit(1)).alias("lines"))
    fine = found.where("reasons = ''").groupBy("symbol", F.lit(None).cast("date").alias("date"), F.lit("fine").alias("reasons")).agg(F.count(F.lit(1)).alias("lines"))
    return bad.unionByName(fine)


# ---- V4: what was committed is computed again


def _study(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Fold counts with probabilities, predictions and their metrics, from running sums."""
    rows = checkpointed(matured(spark, sf_dir))
    ups = F.col("ups0") + F.col("ups1") + F.col("ups2")
    folds = wf.fold_probabilities(wf.expanding_counts(rows, months(spark), ["symbol"]), shrink=P.shrink * 7, least=365).withColumn("ups", ups)
    predictions = wf.predictions(rows, folds, ["symbol"]).select("symbol", "date", "target", F.col("prior").alias("probability"))
    counts = folds.select("symbol", F.col("cutoff").alias("date"), "train_rows", "ups", F.col("prior").alias("probability"))
    metrics = sc.metrics(predictions, ["symbol"]).select("symbol", F.lit(P.data_end).alias("date"), "total", "accuracy", "brier")
    return {"counts": counts, "predictions": predictions, "metrics": metrics}


def _again(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same by another way: training rows of each fold by a join, shares by group."""
    rows = checkpointed(matured(spark, sf_dir))
    joined = lb.folds_of(rows, months(spark)).where("role = 'train'")
    counts = checkpointed(cal.prior_probability(joined, ["symbol", "cutoff"]).where("n >= 365"))
    named = counts.select("symbol", F.col("cutoff").alias("date"), F.col("n").alias("train_rows"), "ups", "probability")
    tested = lb.folds_of(rows, months(spark)).where("role = 'test'").join(counts.select("symbol", "cutoff", "probability"), ["symbol", "cutoff"])
    predictions = tested.select("symbol", "date", "target", "probability")
    right = F.avg((sc.classify("probability") == F.col("target")).cast("double"))
    metrics = predictions.groupBy("symbol").agg(F.lit(P.data_end).alias("date"), F.count(F.lit(1)).alias("total"), right.alias("accuracy"), F.avg((F.col("probability") - F.col("target")) ** 2).alias("brier"))
    return {"counts": named, "predictions": predictions, "metrics": metrics.select("symbol", "date", "total", "accuracy", "brier")}


@query("v4_reproduce_artifacts", f"""{S.FOLDS} SELECT symbol, 'counts' AS artifact, cutoff AS date, 'ups' AS what FROM prob WHERE month(cutoff) = 6 AND train_rows >= 365
UNION ALL SELECT symbol, 'predictions', date, 'probability' FROM wide WHERE day(date) = 13 UNION ALL SELECT symbol, 'predictions', date, 'missing_in_a' FROM wide WHERE day(date) = 14
UNION ALL SELECT DISTINCT symbol, 'metrics', DATE '{P.data_end}', 'brier' FROM wide WHERE symbol = 'F'""")
def v4a(spark, d):
    """Counts, probabilities, predictions, accuracy and Brier score of a committed study, against the same computed another way; some were altered before they were committed."""
    root = scratch(spark, "artifacts")
    parts = {"counts": [], "predictions": ["symbol"], "metrics": []}
    made = _study(spark, d)
    for name, df in made.items():
        store.commit(df, f"{root}/{name}", parts=parts[name], about={"kind": "first"})
    day, month = F.dayofmonth("date"), F.month("date")
    altered = {
        "counts": lambda df: df.withColumn("ups", F.col("ups") + (month == 6).cast("long")),
        "predictions": lambda df: df.where(day != 14).withColumn("probability", F.col("probability") + F.when(day == 13, 1e-9).otherwise(0.0)),
        "metrics": lambda df: df.withColumn("brier", F.col("brier") + F.when(F.col("symbol") == "F", 1e-9).otherwise(0.0)),
    }
    for name, change in altered.items():
        store.commit(change(store.open_table(spark, f"{root}/{name}", number=1)), f"{root}/{name}", parts=parts[name])
    again, out = _again(spark, d), None
    for name in made:
        found = sv.reproduce(store.open_table(spark, f"{root}/{name}"), again[name], ["symbol", "date"]).select("symbol", F.lit(name).alias("artifact"), "date", F.concat_ws(",", "what").alias("what"))
        out = found if out is None else out.unionByName(found)
    return out
