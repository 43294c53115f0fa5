"""Forms for series, groups and training sets larger than a task, against the plain ones; committed artifacts; CSV with faults."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import backtest as bt, calibration as cal, chunks, features as ft, labels as lb, models as md, newton, quality as ql, serving as sv
from barlab.schemas import BAR, Protocol
from barlab.sources import artifacts as store, files as io

D0 = date(2000, 1, 1)


def bars_of(n, seed=1, symbols="XY", gaps=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in np.flatnonzero(rng.random(n) >= gaps):
            c = float(close[i])
            o = c * (1 + float(rng.normal(0, 0.005)))
            rows.append((s, D0 + timedelta(int(i)), o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rng.integers(1, 99))))
    return rows


# ---- chunks


@pytest.mark.parametrize("days,gaps", [(400, 0.0), (60, 0.3), (7, 0.5)])
def test_features_in_chunks_equal_those_of_the_series(spark, days, gaps):
    b = spark.createDataFrame(bars_of(900, gaps=gaps), BAR)
    whole = {(r.symbol, r.date): r for r in ft.all_features(b).collect()}
    cut = chunks.in_chunks(b, ft.all_features, halo=200, days=days)
    got = cut.collect()
    assert len(got) == len(whole) and all(r == whole[r.symbol, r.date] for r in got)


def test_a_halo_holds_the_rows_before_and_no_more(spark):
    b = spark.createDataFrame(bars_of(300, symbols="X", gaps=0.4), BAR)
    got = chunks.with_halo(b, halo=25, days=10).collect()
    dates = sorted({r.date for r in got})
    assert sorted(r.date for r in got if not r.in_halo) == dates
    for c in {r.chunk for r in got}:
        own = sorted(r.date for r in got if r.chunk == c and not r.in_halo)
        halo = sorted(r.date for r in got if r.chunk == c and r.in_halo)
        assert halo == [x for x in dates if x < own[0]][-25:]


def test_one_symbol_is_the_work_of_many_tasks(spark):
    b = spark.createDataFrame(bars_of(2000, symbols="X"), BAR)
    parts = chunks.with_halo(b, halo=200, days=100).select(F.concat_ws("#", "symbol", "chunk").alias("k")).distinct().count()
    assert parts >= 20


# ---- simulation in pieces


def test_pieces_equal_the_sequential_pass(spark):
    rng = np.random.default_rng(4)
    n = 1000
    runs = [("a", "zero", 0.0015), ("a", "never", 0.0), ("a", "steady", 0.005), ("a", "late", 0.001)]
    target = np.stack([rng.choice([0, 0.3, 0.7, 1.0], n), np.full(n, 0.5), 0.5 + 0.5 * np.sin(np.arange(n) / 40), np.where(np.arange(n) < 300, np.nan, 0.8)], axis=1)
    rows = [(s, D0 + timedelta(i), None if i == n - 1 else float(rng.normal(0, 0.02)), [None if np.isnan(x) else float(x) for x in target[i]]) for s in "XY" for i in range(n)]
    frame = spark.createDataFrame(rows, "symbol string, date date, next_return double, targets array<double>")
    key = lambda r: (r.symbol, r.strategy, r.execution_date)
    whole = {key(r): r for r in bt.simulate(frame, runs, 0.05).collect()}
    for days in (1, 37):
        if days == 1:
            some = frame.where(f"date < '{D0 + timedelta(40)}'")
            want = {key(r): r for r in bt.simulate(some, runs, 0.05).collect()}
        else:
            some, want = frame, whole
        got = {key(r): r for r in bt.simulate_in_pieces(some, runs, 0.05, days=days).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert (got[k].weight, got[k].turnover, got[k]["return"], got[k].cost_fraction) == (r.weight, r.turnover, r["return"], r.cost_fraction)
            assert got[k].equity == pytest.approx(r.equity, rel=1e-12)


def test_a_piece_refuses_weights_outside_of_0_and_1(spark):
    frame = spark.createDataFrame([("X", D0, 0.0, [1.5])], "symbol string, date date, next_return double, targets array<double>")
    with pytest.raises(Exception, match="outside 0 and 1"):
        bt.simulate_in_pieces(frame, [("a", "m", 0.0)], 0.05).collect()


# ---- Newton


def train_rows(spark, n=900, d=3, seed=5, symbols="XY"):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        x = rng.normal(0, 1, (n, d)) * (1, 20, 0.01)[:d]
        x[:, -1] = np.where(rng.random(n) < 0.01, 9.0, x[:, -1])
        p = 1 / (1 + np.exp(-(0.3 + x[:, 0])))
        rows += [(s, D0 + timedelta(i), D0 + timedelta(i + 7), int(rng.random() < p[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, label_end date, target int, " + ", ".join(f"f{i} double" for i in range(d)))


@pytest.mark.parametrize("window", [None, 400])
@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_newton_equals_the_fit_of_each_fold(spark, monkeypatch, window, most_sent):
    monkeypatch.setattr(newton, "MOST_SENT", most_sent)
    rows, names = train_rows(spark), ["f0", "f1", "f2"]
    cuts = [D0 + timedelta(k) for k in (100, 500, 700, 905)]
    plain = {(r.symbol, r.cutoff): r for r in md.logistic_folds(rows, ["symbol"], names, cuts, penalty=0.05, window_days=window).collect()}
    got = {(r.symbol, r.cutoff): r for r in newton.newton_folds(rows, ["symbol"], names, cuts, penalty=0.05, window_days=window).collect()}
    assert got.keys() == plain.keys() and len(got) == 6
    for k, r in plain.items():
        assert (got[k].train_rows, got[k].train_label_end) == (r.train_rows, r.train_label_end)
        np.testing.assert_allclose(got[k].center, r.center, rtol=1e-10)
        np.testing.assert_allclose(got[k].scale, r.scale, rtol=1e-10)
        # the plain fit stops at a gradient of 1e-7; one more step takes it to the optimum
        np.testing.assert_allclose(got[k].coefficients, r.coefficients, atol=2e-6)


def test_newton_gradient_vanishes_and_pools_symbols(spark):
    rows = train_rows(spark, d=2)
    fit = newton.newton_folds(rows, [], ["f0", "f1"], [date(2010, 1, 1)], penalty=0.1, least=10).first()
    data = rows.toPandas()
    z = np.clip((data[["f0", "f1"]].to_numpy() - fit.center) / fit.scale, -8, 8)
    design = np.column_stack((np.ones(len(z)), z))
    p = 1 / (1 + np.exp(-design @ fit.coefficients))
    gradient = design.T @ (p - data["target"]) / len(data) + 0.1 * np.r_[0, fit.coefficients[1:]]
    assert fit.train_rows == len(data) == 1800 and np.abs(gradient).max() < 1e-9
    exact = md.fit_logistic(z, data["target"].to_numpy(float), 0.1, np.array(fit.coefficients), tolerance=1e-12)
    np.testing.assert_allclose(fit.coefficients, exact, atol=1e-8)


def test_newton_on_separated_constant_and_missing_training(spark):
    rows = spark.createDataFrame([("X", D0 + timedelta(i), D0 + timedelta(i), int(i >= 50), float(i >= 50), 3.0) for i in range(100)], "symbol string, date date, label_end date, target int, f0 double, f1 double")
    fit = newton.newton_folds(rows, ["symbol"], ["f0", "f1"], [date(2001, 1, 1)], penalty=0.001, least=50).first()
    assert fit.coefficients[1] > 3 and fit.coefficients[2] == 0
    assert newton.newton_folds(rows, ["symbol"], ["f0", "f1"], [D0], penalty=0.1).collect() == []
    with pytest.raises(ArithmeticError):
        newton.newton_folds(rows, ["symbol"], ["f0"], [date(2001, 1, 1)], penalty=0.001, least=50, steps=2)


# ---- quantiles


def test_refined_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(8)
    values = {"normal": rng.normal(0, 1, 501), "ties": rng.choice([1.0, 2.0, 2.5], 400), "one": [3.0], "two": [-1e308, 1e308], "wide": 10.0 ** rng.uniform(-300, 300, 300), "same": [7.0] * 50}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("none", None), ("one", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    for cells in (2, 64):
        got = {r.k: (r.q10, r.q50, r.q95) for r in cal.refined_quantiles(df.where("k <> 'wide'") if cells == 2 else df, ["k"], "v", quantiles=(0.1, 0.5, 0.95), cells=cells).collect()}
        for k, v in values.items():
            if k in got and k != "two":
                assert got[k] == pytest.approx(tuple(np.quantile(v, (0.1, 0.5, 0.95))), rel=1e-12)
        assert "none" not in got and got["one"] == (3.0, 3.0, 3.0) and got["two"][1] == 0.0


# ---- artifacts on a time line


def test_the_artifact_valid_on_a_date(spark):
    models = spark.createDataFrame([("X", D0, D0 + timedelta(10), 0.4), ("X", D0 + timedelta(10), D0 + timedelta(12), 0.6), ("Y", D0 + timedelta(3), D0 + timedelta(9), 0.5)], "symbol string, refit_date date, valid_until date, probability double")
    asked = spark.createDataFrame([(s, D0 + timedelta(i)) for s in "XYZ" for i in range(-1, 14)] + [("X", D0)], "symbol string, date date")
    got = lb.as_of_model(asked, models, ["symbol"])
    assert got.columns == ["symbol", "date", "refit_date", "valid_until", "probability"] and got.count() == 46
    on = lambda s, i: {"X": 0.4 if 0 <= i < 10 else 0.6 if 10 <= i < 12 else None, "Y": 0.5 if 3 <= i < 9 else None, "Z": None}[s]
    assert all(r.probability == on(r.symbol, (r.date - D0).days) for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    twice = models.union(spark.createDataFrame([("X", D0 + timedelta(4), D0 + timedelta(6), 0.1)], models.schema))
    with pytest.raises(Exception, match="two artifacts hold"):
        lb.as_of_model(asked, twice, ["symbol"]).collect()


# ---- differences by fingerprints


def test_only_differing_days_are_compared(spark):
    a = spark.createDataFrame([(s, D0 + timedelta(i), float(i)) for s in ("X", "Y", None) for i in range(400)], "symbol string, date date, v double")
    b = a.where(~((F.col("symbol") == "X") & (F.col("date") == D0 + timedelta(5)))).withColumn("v", F.col("v") + F.when((F.col("symbol") == "Y") & (F.col("date") == D0 + timedelta(200)), 1.0).otherwise(0.0)).repartition(5)
    found, compared = ql.dataset_diff_by_fingerprints(a, b, ["symbol", "date"])
    assert sorted((r.symbol, (r.date - D0).days, r.what) for r in found.collect()) == [("X", 5, ["missing_in_b"]), ("Y", 200, ["v"])]
    assert compared.count() == 2
    assert ql.differing_days(a, a.repartition(3), ["symbol", "date"]).collect() == []
    twice, _ = ql.dataset_diff_by_fingerprints(a, a.union(a.limit(0)), ["symbol", "date"])
    assert twice.collect() == []


# ---- committed artifacts


def test_a_table_is_read_as_it_was_committed(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(s, D0 + timedelta(i), None if i == 3 else float(i)) for s in "XY" for i in range(20)], "symbol string, date date, v double")
    with pytest.raises(FileNotFoundError):
        store.open_table(spark, root)
    assert store.commit(df, root, parts=["symbol"], about={"kind": "first"}) == 1
    assert store.commit(df.where("v > 5"), root) == 2
    assert store.open_table(spark, root).count() == 28 and store.open_table(spark, root, number=1).count() == 40
    assert ql.dataset_diff(df, store.open_table(spark, root, number=1), ["symbol", "date"]).collect() == []
    assert [(e["number"], e.get("kind")) for e in store.log(spark, root)] == [(1, "first"), (2, None)]
    assert store.open_table(spark, root, number=1, where="symbol = 'X'").count() == 20


def test_damaged_and_unfinished_versions_are_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(s, float(i)) for s in "XY" for i in range(20)], "symbol string, v double").coalesce(1)
    store.commit(df, root, parts=["symbol"])
    version = store.log(spark, root)[0]["version"]
    # a version without an entry in the log is not there
    df.write.parquet(f"{root}/versions/unfinished/data")
    assert store.open_table(spark, root).count() == 40
    # one row more in a part: that part is refused, the other can be read
    spark.createDataFrame([(5.0,)], "v double").write.mode("append").parquet(f"{root}/versions/{version}/data/symbol=X")
    with pytest.raises(store.Damaged, match="symbol"):
        store.open_table(spark, root)
    assert store.open_table(spark, root, where="symbol = 'Y'").count() == 20
    # another job has taken the number
    (tmp_path / "t" / "log" / "00000002.json").write_text("{}")
    (tmp_path / "t" / "log" / "00000002.json").rename(tmp_path / "t" / "log" / "00000002.json.taken")
    assert store.commit(df, root) == 2


# ---- CSV


def test_lines_with_too_many_or_too_few_fields(spark, tmp_path):
    path = tmp_path / "bars.csv"
    good = "x,11,2024-01-{:02d},10,12,9,5"
    lines = ["﻿Note,Close,DATE,open,HIGH,low,volume", good.format(1), "x,11,2024-01-02,10,12,9", good.format(3) + ",more", "", good.format(4), '"a, b",11,2024-01-05,"10",12,9,5', "x,11,2024-02-30,10,12,9,5", "x,1e999,2024-01-06,10,12,9,5"]
    path.write_bytes("\r\n".join(lines).encode())
    read = io.read_bars_csv(spark, str(path), symbol="S")
    got = {r.date.day if r.date else 0: r.reasons for r in ql.violations(read).collect()}
    assert got == {1: [], 2: ["volume_not_numeric", "wrong_column_count"], 3: ["wrong_column_count"], 4: [], 5: [], 0: ["bad_date"], 6: ["close_not_numeric"]}
    assert [r.malformed for r in read.where("malformed IS NOT NULL").orderBy("date").collect()] == [lines[2], lines[3]]
    # reading few columns finds them too
    assert read.select("close", "malformed").where("malformed IS NOT NULL AND close = 11").count() == 2
    assert ql.clean(read).count() == 3


def test_fixed_decimals_are_written_and_read_back(spark, tmp_path):
    rows = [("X", D0, 1.0, 2.0, 0.5, 1.23456789, 1e15), ("X", D0 + timedelta(1), float("nan"), float("inf"), None, 1e-12, -0.0)]
    df = spark.createDataFrame(rows, BAR)
    io.write_table(df, str(tmp_path / "c"), form="csv", by=["symbol"], digits=4)
    text = "".join(p.read_text() for p in tmp_path.glob("c/symbol=X/*.csv"))
    assert "1.2346" in text and "1000000000000000.0000" in text and "NaN" not in text and "E" not in text
    back = {r.date: r for r in io.read_bars_csv(spark, str(tmp_path / "c")).collect()}
    assert back[D0].close == 1.2346 and back[D0].symbol == "X" and back[D0 + timedelta(1)].open is None and back[D0].malformed is None
    io.write_table(df, str(tmp_path / "j"), form="json", digits=2)
    assert sorted(r.close for r in spark.read.json(str(tmp_path / "j")).collect()) == [0.0, 1.23]


# ---- leakage of a study


def test_every_part_of_a_study_is_compared(spark):
    f = lambda shift: spark.createDataFrame([("X", D0 + timedelta(i), float(i + (i >= shift))) for i in range(10)], "symbol string, date date, v double")
    found = sv.study_leaks({"features": f(99), "fits": f(99)}, {"features": f(6), "fits": f(3)}, ["symbol", "date"], D0 + timedelta(5)).collect()
    assert sorted((r.part, (r.date - D0).days, r.what) for r in found) == [("fits", 3, "v"), ("fits", 4, "v"), ("fits", 5, "v")]
