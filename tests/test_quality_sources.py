from datetime import date

import pytest
from pyspark.sql import functions as F

from barlab.operators import quality as ql
from barlab.schemas import BAR
from barlab.sources import files as io
from barlab.sources.ticks import bars_from_ticks

DAY = io.DAY_MS
GOOD = ["946684800000", "10", "12", "9", "11", "5", "946771199999", "0", "1", "0", "0", "0"]


def klines(spark, rows):
    import json

    return io.read_klines(spark.createDataFrame([("X", json.dumps(rows))], "symbol string, value string"))


def reasons(df, **o):
    return [sorted(r["reasons"]) for r in ql.violations(df, **o).orderBy("date").collect()]


def test_klines_types(spark):
    row = klines(spark, [GOOD]).first()
    assert (row["date"], row["open"], row["high"], row["low"], row["close"], row["volume"]) == (date(2000, 1, 1), 10.0, 12.0, 9.0, 11.0, 5.0)
    assert reasons(klines(spark, [GOOD]), fields=12) == [[]]


@pytest.mark.parametrize(
    ("place", "value", "reason"),
    [
        (1, "0x10", "open_not_numeric"),
        (1, "", "open_not_numeric"),
        (2, "Infinity", "high_not_numeric"),
        (3, "NaN", "low_not_numeric"),
        (4, "1e999", "close_not_numeric"),
        (5, "-1", "volume_negative"),
        (3, "0", "price_not_positive"),
        (3, "-2", "price_not_positive"),
        (2, "10.5", "high_too_low"),
        (3, "10.5", "low_too_high"),
    ],
)
def test_bad_values(spark, place, value, reason):
    row = list(GOOD)
    row[place] = value
    assert reason in reasons(klines(spark, [row]))[0]


def test_short_rows_and_open_days(spark):
    assert "too_few_fields" in reasons(klines(spark, [GOOD[:5]]), fields=7)[0]
    assert "not_closed" in reasons(klines(spark, [GOOD]), as_of=date(2000, 1, 1))[0]


def test_closed_at_the_exact_midnight(spark):
    ms = 946684800000
    assert ql.closed_only(klines(spark, [GOOD]), ms + DAY).count() == 1
    assert ql.closed_only(klines(spark, [GOOD]), ms + DAY - 1).count() == 0
    with pytest.raises(Exception, match="future"):
        ql.closed_only(klines(spark, [GOOD]), ms - 1).count()


def csv(spark, tmp_path, text):
    (tmp_path / "bars.csv").write_text(text, encoding="utf-8")
    return io.read_bars_csv(spark, str(tmp_path / "bars.csv"), symbol="X")


def test_csv_any_order_case_quotes_and_marks(spark, tmp_path):
    text = '﻿Volume,"DATE",open,HIGH,low,close,note\r\n5,2000-01-02,10,12,9,"11",x\r\n\r\n6,2000-01-01,10,12,9,11,y\r\n'
    got = csv(spark, tmp_path, text)
    assert got.count() == 2 and reasons(got) == [[], []]
    assert {r["volume"] for r in got.collect()} == {5.0, 6.0}


@pytest.mark.parametrize("day", ["2026-02-30", "2026-2-3", "03/02/2026", "", "not a date"])
def test_csv_bad_dates(spark, tmp_path, day):
    got = csv(spark, tmp_path, f"date,open,high,low,close,volume\n{day},10,12,9,11,5\n")
    assert all("bad_date" in r for r in reasons(got))


def test_csv_missing_column(spark, tmp_path):
    with pytest.raises(ValueError, match="volume"):
        csv(spark, tmp_path, "date,open,high,low,close\n2000-01-01,10,12,9,11\n")


def test_quotes(spark):
    bad = ["0", "-1", "NaN", "Infinity", "1e999", "", "abc", "0x1", " "]
    rows = [(f'{{"symbol":"X","price":"{p}"}}', i) for i, p in enumerate(bad)] + [('{"symbol":"X","price":"2.5"}', 90), ('{"symbol":"Y","price":"3"}', 91), ("not json", 92)]
    got = io.read_quotes(spark.createDataFrame(rows, "value string, received_at long"), wanted="X").collect()
    assert [(r["price"], r["received_at"]) for r in got] == [(2.5, 90)]


def bars(spark, days, symbol="X"):
    return spark.createDataFrame([(symbol, d, 10.0, 12.0, 9.0, 11.0, 1.0) for d in days], BAR)


def test_duplicates_gaps_segments(spark):
    b = bars(spark, [date(2000, 1, 1), date(2000, 1, 2), date(2000, 1, 2), date(2000, 1, 5)])
    assert ql.duplicate_dates(b).count() == 1
    gap = ql.gap_report(b).first()
    assert (gap["before"], gap["after"], gap["missing"]) == (date(2000, 1, 2), date(2000, 1, 5), 2)
    assert [r["date"] for r in ql.missing_dates(b).orderBy("date").collect()] == [date(2000, 1, 3), date(2000, 1, 4)]
    assert sorted(r["segment"] for r in ql.contiguous_segments(b.distinct()).collect()) == [0, 0, 1]


def test_pages_overlap_is_found(spark):
    later = list(GOOD)
    assert ql.duplicate_dates(io.merge_pages(klines(spark, [GOOD]), klines(spark, [later]))).count() == 1


def test_pages_must_join(spark):
    page = lambda *days: bars(spark, [date(2000, 1, d) for d in days])
    assert io.joined_pages(page(1, 2), page(3, 4), page(5)).count() == 5
    for wrong, problem in ((page(4, 5), "gap"), (page(2, 3), "overlap")):
        assert [(r["problem"], r["days"]) for r in io.page_borders(page(1, 2), wrong).collect()] == [(problem, 1)]
        with pytest.raises(Exception, match=problem):
            io.joined_pages(page(1, 2), wrong).count()


@pytest.mark.parametrize("page", ["not json", "{}", "[]", "[1, 2]", None])
def test_bad_pages_are_rejected(spark, page):
    got = io.read_klines(spark.createDataFrame([("X", page)], "symbol string, value string"))
    assert [set(r["reasons"]) >= {"bad_date", "too_few_fields"} for r in ql.rejects(got, fields=7).collect()] == [True] * got.count() and got.count() > 0
    assert ql.clean(got, fields=7).count() == 0


def test_csv_repeated_column(spark, tmp_path):
    with pytest.raises(ValueError, match="close"):
        csv(spark, tmp_path, "date,open,high,low,close,volume,Close\n2000-01-01,10,12,9,11,5,11\n")
    strings = spark.createDataFrame([("2000-01-01", *"123456")], ["date", "open", "high", "low", "close", "volume", " Close"])
    with pytest.raises(ValueError, match="twice"):
        io.bars_from_strings(strings)


def test_a_repeated_row_changes_the_fingerprint(spark):
    days = [date(2000, 1, d) for d in range(1, 5)]
    frozen = ql.manifest(bars(spark, days))
    assert ql.manifest_diff(frozen, ql.manifest(bars(spark, days[::-1]))).count() == 0
    twice = ql.manifest_diff(frozen, ql.manifest(bars(spark, days + days[:1] * 2))).first()
    assert {"rows", "fingerprint"} <= set(twice["what"])


def test_manifest_does_not_depend_on_order(spark):
    days = [date(2000, 1, d) for d in range(1, 9)]
    a, b = (ql.manifest(bars(spark, x)).first() for x in (days, days[::-1]))
    assert a == b


def test_dataset_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13), (2, 2.5), (4, 4.0)], "k int, v double")
    got = {r["k"]: r["what"] for r in ql.dataset_diff(a, b, ["k"], tolerance=1e-12).collect()}
    assert got == {2: ["v"], 3: ["missing_in_b"], 4: ["missing_in_a"]}


def test_written_numbers_are_finite(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    io.write_table(df, str(tmp_path / "out"), form="json")
    assert sorted(str(r["x"]) for r in spark.read.schema("x double").json(str(tmp_path / "out")).collect()) == ["1.0", "None", "None"]


def test_ticks_tie_order_and_nulls(spark):
    t = spark.createDataFrame([("X", date(2000, 1, 1), 2, 5.0, 1.0), ("X", date(2000, 1, 1), 1, 4.0, 1.0), ("X", None, 1, 4.0, 1.0), (None, date(2000, 1, 1), 1, 4.0, 1.0)], "s string, d date, k int, p double, v double")
    got = bars_from_ticks(t, symbol=F.col("s"), day=F.col("d"), price=F.col("p"), volume=F.col("v"), order=[F.col("k")]).collect()
    assert [(r["open"], r["close"], r["volume"]) for r in got] == [(4.0, 5.0, 2.0)]
