from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import backtest as bt, bootstrap as boot, calibration as cal, features as ft, labels as lb, models as md, performance as pf, scoring as sc, serving as sv, walkforward as wf
from barlab.schemas import Protocol

P = Protocol()


def walk(n=420, seed=1, symbol="X", constant=False):
    rng = np.random.default_rng(seed)
    close = np.full(n, 50.0) if constant else 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    opened = np.concatenate(([close[0]], close[:-1])) * (1 if constant else np.exp(rng.normal(0, 0.005, n)))
    days = [date(1997, 1, 1) + timedelta(i) for i in range(n)]
    return pd.DataFrame({"symbol": symbol, "date": days, "open": opened, "high": np.maximum(opened, close) * 1.01, "low": np.minimum(opened, close) * 0.99, "close": close, "volume": rng.integers(1, 100, n).astype(float)})


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk())


def test_indicators_against_pandas(spark, bars):
    got = ft.indicators(bars, P).orderBy("date").toPandas()
    c = walk()["close"]
    lr = np.log(c).diff()
    np.testing.assert_allclose(got["sma"].astype(float), c.rolling(200).mean(), rtol=1e-10)
    np.testing.assert_allclose(got["momentum"].astype(float), c / c.shift(63) - 1, rtol=1e-9)
    np.testing.assert_allclose(got["vol"].astype(float), lr.rolling(30).std() * np.sqrt(365), rtol=1e-8)
    assert got["score"].isna().sum() == 199


def test_rsi_warm_up_stays_null_and_flat_is_half(spark):
    flat = ft.all_features(spark.createDataFrame(walk(40, constant=True))).orderBy("date").toPandas()
    assert flat["rsi14"].isna().sum() == 14 and set(flat["rsi14"].dropna()) == {0.5}
    assert flat["volume_z"].isna().sum() == 19


def test_constant_prices(spark):
    got = ft.indicators(spark.createDataFrame(walk(260, constant=True)), P).where("score IS NOT NULL").toPandas()
    assert set(got["vol"]) == {0.0} and set(got["weight"]) == {1.0} and set(got["score"]) == {0}
    assert set(ft.strategy_weights(ft.indicators(spark.createDataFrame(walk(260, constant=True)), P)).where("score IS NOT NULL").toPandas()["trend_model"]) == {0.0}


def test_unknown_feature_set():
    with pytest.raises(ValueError):
        ft.feature_set("none")
    basic = {"return_7", "return_30", "return_63", "ma50", "ma200", "vol30", "rsi14", "vol_ratio"}
    assert set(ft.feature_set("basic")) == basic and len(ft.BASIC) == 8
    assert set(ft.feature_set("expanded")) - basic == {"return_1", "return_3", "return_14", "return_126", "ma20", "vol90", "atr14", "volume_z", "range", "close_position"}
    assert set(ft.feature_set("interactions")) - basic == {*(f"{c}_sq" for c in basic), "ma200_return63", "rsi_ma200", "return30_vol30"}


def test_future_changes_leave_the_past(spark, bars):
    cut = date(1997, 12, 1)
    f = lambda b: ft.all_features(b).drop("open", "close")
    later = bars.withColumns({c: F.when(F.col("date") > F.lit(cut), F.col(c) * 2).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    assert sv.leaks(f(bars), f(later), ["symbol", "date"], cut).count() == 0
    assert sv.leaks(f(bars), f(bars.where(F.col("date") <= F.lit(cut))), ["symbol", "date"], cut).count() == 0


# ---- simulation


def runs(returns, target, cost=0.0, band=0.05):
    r = np.array(returns, float)
    t = np.array(target, float).reshape(len(r), 1)
    return [x[:, 0] for x in bt.run_weights(r, t, np.ones_like(t, bool), np.array([cost]), band)]


def test_accounting_identities():
    net, *_ = runs([0.1, -0.05, 0.02], [1, 1, 1])
    assert np.prod(1 + net) == pytest.approx(1.1 * 0.95 * 1.02)
    assert np.prod(1 + runs([0.1, -0.5, 2], [0, 0, 0], 0.0015)[0]) == 1
    assert np.prod(1 + runs([0, 0, 0], [1, 0, 0], 0.0015)[0]) == pytest.approx((1 - 0.0015) / (1 + 0.0015))
    assert runs([0.0], [1], 0.0015)[2][0] == pytest.approx(1 / 1.0015)


def test_band_keeps_the_drifted_weight():
    _, weight, turnover, _ = runs([0.2, 0.0, 0.0], [0.5, 0.5, 0.56], band=0.05)
    drifted = 0.5 * 1.2 / 1.1
    assert weight[1] == pytest.approx(drifted) and turnover[1] == 0
    assert turnover[2] == 0


def plain_simulation(r, target, cost, band):
    held, out = 0.0, []
    for x, goal in zip(r, target):
        if abs(goal - held) >= band or (goal == 0 and held != 0) or (goal > 0 and held == 0):
            turn = abs((goal - held) / (1 + cost * goal if goal >= held else 1 - cost * goal))
            w = goal
        else:
            turn, w = 0.0, held
        out.append((1 - cost * turn) * (1 + w * x) - 1)
        held = w * (1 + x) / (1 + w * x)
    return np.array(out)


def test_simulation_against_a_plain_loop():
    rng = np.random.default_rng(3)
    r, t = rng.normal(0, 0.03, 300), rng.choice([0, 0.3, 0.33, 0.7, 1.0], 300)
    np.testing.assert_allclose(runs(r, t, 0.0015)[0], plain_simulation(r, t, 0.0015, 0.05), atol=1e-14)


def test_buy_and_hold_is_the_price_ratio(spark, bars):
    p = Protocol(cost_bps=0)
    s = bt.Scenario("h", date(1997, 8, 1), date(1998, 3, 1), 0.0)
    d = bt.backtest(bars, [s], p).where("strategy = 'buy_hold'").orderBy("execution_date").toPandas()
    o = walk().set_index("date")["open"]
    want = o[d["execution_date"].iloc[-1] + timedelta(1)] / o[d["execution_date"].iloc[0]]
    assert d["equity"].iloc[-1] == pytest.approx(want)


def test_years_start_from_cash(spark, bars):
    runs_ = [bt.Scenario("a", date(1997, 8, 1), date(1998, 3, 1)), bt.Scenario("b", date(1998, 1, 1), date(1998, 3, 1))]
    d = bt.backtest(bars, runs_, P).where("strategy = 'buy_hold'").toPandas()
    first = d[d["scenario"] == "b"].sort_values("execution_date").iloc[0]
    assert first["turnover"] == pytest.approx(1 / 1.0015)
    same = d[(d["scenario"] == "a") & (d["execution_date"] == first["execution_date"])].iloc[0]
    assert same["turnover"] == 0


def test_stats(spark):
    r = [0.1, -0.2, 0.0, 0.05, 0.3]
    rows = [("X", "s", "m", date(2000, 1, 1 + i), x, 1.0, 0.0, 0.0, 1.0) for i, x in enumerate(r)]
    got = pf.performance_stats(spark.createDataFrame(rows, bt.DAILY)).first()
    eq = np.cumprod(1 + np.array(r))
    assert got["total_return"] == pytest.approx(eq[-1] - 1)
    assert got["max_drawdown"] == pytest.approx(-0.2) and got["longest_underwater_days"] == 3
    assert got["sharpe"] == pytest.approx(np.mean(r) * 365 / (np.std(r, ddof=1) * np.sqrt(365)))


# ---- probabilities


def test_calibration_counts_and_empty_scores(spark):
    rows = spark.createDataFrame([("X", 0, 1), ("X", 0, 0), ("X", 2, 1), ("X", 2, None)], "symbol string, score int, target int")
    assert cal.prior_probability(rows, ["symbol"]).first()["probability"] == pytest.approx(3 / 5)
    got = {r["score"]: r["probability"] for r in cal.regime_probability(rows, ["symbol"]).collect()}
    assert got == {0: pytest.approx(0.5), 1: 0.5, 2: pytest.approx(2 / 3)}


def test_metrics_of_one_class_have_null_recall(spark):
    got = sc.metrics(spark.createDataFrame([("X", 0.5, 1), ("X", 0.4, 1)], "symbol string, probability double, target int"), ["symbol"]).first()
    assert (got["tp"], got["fn"], got["down_recall"], got["balanced_accuracy"]) == (1, 1, None, None)


def test_auc_with_ties(spark):
    rows = [("X", p, y) for p, y in [(0.2, 0), (0.5, 1), (0.5, 0), (0.9, 1)]]
    assert sc.auc(spark.createDataFrame(rows, "symbol string, probability double, target int"), ["symbol"]).first()["auc"] == pytest.approx(0.875)


def test_reliability_edges(spark):
    assert sc.reliability_edges()[3] == 0.30000000000000004
    got = sc.reliability_bins(spark.createDataFrame([("X", 0.3, 1), ("X", 1.0, 1)], "symbol string, probability double, target int"), ["symbol"]).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 0, 1, 0, 0, 0, 0, 0, 0, 1]


def test_logistic_balanced_identical_is_half():
    beta = md.fit_logistic(np.ones((40, 2)), np.array([0, 1] * 20, float), 0.1)
    assert 1 / (1 + np.exp(-(beta[0] + beta[1:].sum()))) == pytest.approx(0.5)


def test_logistic_gradient_vanishes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    b = md.fit_logistic(x, y, 0.1)
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    assert abs((p - y).mean()) < 1e-6 and np.abs(x.T @ (p - y) / 300 + 0.1 * b[1:]).max() < 1e-6


def test_expanding_counts_purge_strictly(spark):
    rows = spark.createDataFrame([("X", date(2000, 1, 1), date(2000, 1, 8), 1, 1), ("X", date(2000, 1, 2), date(2000, 1, 9), 1, 0), ("X", date(2000, 1, 3), date(2000, 1, 10), 2, 1)], "symbol string, date date, label_end date, score int, target int")
    cuts = spark.createDataFrame([(date(2000, 1, 9),), (date(2000, 1, 11),)], "cutoff date")
    got = {r["cutoff"]: (r["n1"], r["ups1"], r["n2"]) for r in wf.expanding_counts(rows, cuts, ["symbol"]).collect()}
    assert got == {date(2000, 1, 9): (1, 1, 0), date(2000, 1, 11): (2, 1, 1)}
    window = {r["cutoff"]: (r["n1"], r["n2"]) for r in wf.expanding_counts(rows, cuts, ["symbol"], window_days=9, span=7).collect()}
    assert window == {date(2000, 1, 9): (1, 0), date(2000, 1, 11): (1, 1)}


def test_monthly_fold_rows_match_the_published_audit(spark):
    """A bare calendar gives the published number of training rows (633 at 2020-01-01 for 7 days)."""
    days = spark.sql("SELECT 'X' AS symbol, explode(sequence(DATE '2018-04-01', DATE '2026-09-16')) AS date").withColumns({"label_end": F.date_add("date", 7), "score": F.lit(0), "target": F.lit(1)})
    matured = days.where("label_end <= '2026-09-16'")
    got = wf.fold_probabilities(wf.expanding_counts(matured, wf.folds(spark, date(2020, 1, 1), date(2026, 9, 2)), ["symbol"]), least=365)
    rows = {r["cutoff"]: r["train_rows"] for r in got.collect()}
    assert rows[date(2020, 1, 1)] == 633 and len(rows) == 81


def test_annual_fold_rows_match_the_published_audit(spark):
    """The same for the annual folds of 32-day labels, in both phases and with a window of 730 days."""
    from barlab.jobs.registry import _fold_audit

    days = spark.sql("SELECT 'X' AS symbol, explode(sequence(DATE '2018-04-01', DATE '2026-09-16')) AS date").withColumn("label_end", F.date_add("date", 32)).where("label_end <= '2026-09-16'")
    got = _fold_audit(spark, days, wf.folds(spark, date(2020, 1, 1), date(2026, 12, 31), "year"), (2020, 2021, 2022, 2023), date(2024, 1, 1)).orderBy("cutoff").collect()
    # fixed values: the published counts of training and test rows
    assert [(r["phase"], r["train_rows"], r["test_rows"]) for r in got] == [("development", 608, 366), ("development", 974, 365), ("development", 1339, 365), ("development", 1704, 333), ("reuse", 2069, 366), ("reuse", 2435, 365), ("reuse", 2800, 227)]
    assert got[3]["test_end"] == date(2023, 11, 29) and got[0]["train_label_end"] == date(2019, 12, 31)
    rows = days.withColumns({"score": F.lit(0), "target": F.lit(1)})
    window = wf.expanding_counts(rows, wf.folds(spark, date(2020, 1, 1), date(2024, 1, 1), "year"), ["symbol"], window_days=730, span=32)
    assert [r["n0"] for r in window.orderBy("cutoff").collect()] == [608, 698, 698, 698]


def test_fitted_candidates_against_plain_fits(spark, bars):
    rows = lb.dataset(lb.open_to_open(ft.all_features(bars), 7), list(ft.EXPANDED), start=date(1997, 1, 1)).select("symbol", "date", "label_end", "target", *ft.EXPANDED)
    folds = [(date(1997, 11, 1), date(1998, 1, 1)), (date(1998, 1, 1), date(1999, 1, 1))]
    specs = [s for s in wf.candidate_specs(windows=(None, 100), penalties=(0.1, 1.0), neighbours=(5, 20), sets=("basic", "expanded"))]
    got = md.fitted_candidates(rows, ["symbol"], specs, ft.FEATURE_SETS, folds, least=40).toPandas()
    p = rows.orderBy("date").toPandas()
    p[["date", "label_end"]] = p[["date", "label_end"]].astype("datetime64[s]")
    want = {}
    for name, family, window, kind, penalty, k in specs:
        if family not in ("logistic", "knn"):
            continue
        for cutoff, stop in folds:
            c = pd.Timestamp(cutoff)
            train = p[(p["label_end"] < c) & ((p["date"] >= c - pd.Timedelta(days=window)) if window else True)]
            test = p[(p["date"] >= c) & (p["date"] < pd.Timestamp(stop))]
            x, y = train[list(ft.feature_set(kind))].to_numpy(), train["target"].to_numpy(float)
            if len(x) < max(40, k or 0):
                continue
            scale = lambda v: np.clip((v - x.mean(axis=0)) / x.std(axis=0), -8, 8)
            z, zt = scale(x), scale(test[list(ft.feature_set(kind))].to_numpy())
            if family == "knn":
                far = ((zt[:, None, :] - z[None]) ** 2).sum(axis=2)
                found = (y[np.argsort(far, axis=1, kind="stable")[:, :k]].sum(axis=1) + 1) / (k + 2)
            else:
                b = md.fit_logistic(z, y, penalty)
                found = 1 / (1 + np.exp(-(b[0] + zt @ b[1:])))
            want |= {(name, d.date()): v for d, v in zip(test["date"], found)}
    assert {(r.candidate, r.date): r.probability for r in got.itertuples()} == pytest.approx(want, abs=1e-5) and len(want) > 500


def test_nearest_shares_break_ties_by_order():
    train, y = np.array([[0.0], [1.0], [1.0], [1.0], [5.0]]), np.array([1.0, 0, 1, 1, 1])
    got = md.nearest_shares(train, y, np.array([[1.0], [0.0]]), [2, 4])
    assert got[0].tolist() == [2 / 4, 4 / 6] and got[1].tolist() == [2 / 4, 4 / 6]


def test_blends(spark):
    got = md.blends(spark.createDataFrame([(0.5, 0.7, 0.9)], "prior double, regime double, logistic double"), 0.25).first()
    assert got["logistic_shrunk"] == pytest.approx(0.8) and got["equal_blend"] == pytest.approx(0.75) and (got["always_up"], got["coin_flip"]) == (1.0, 0.5)


def test_the_artifact_holds_what_was_selected(spark):
    counts = spark.createDataFrame([("X", date(2000, 1, 1), 4, 2, 4, 1, 2, 2), ("X", date(2000, 2, 1), 5, 2, 4, 1, 2, 2)], "symbol string, cutoff date, n0 long, ups0 long, n1 long, ups1 long, n2 long, ups2 long")
    chosen = spark.createDataFrame([("X", date(1999, 1, 1), "a"), ("X", date(2000, 1, 1), "b")], "symbol string, cutoff date, selected string")
    fits = spark.createDataFrame([("X", date(2000, 2, 1), date(2000, 1, 31), [0.0], [1.0], [0.1, 0.2])], "symbol string, cutoff date, train_label_end date, center array<double>, scale array<double>, coefficients array<double>")
    got = wf.current_freeze(wf.fold_probabilities(counts), chosen, ["symbol"], fits, names=("f",)).first()
    assert (got["selected"], got["selection_date"], got["refit_date"], got["valid_until"]) == ("b", date(2000, 1, 1), date(2000, 2, 1), date(2000, 3, 1))
    assert got["coefficients"] == [0.1, 0.2] and got["feature_names"] == ["f"] and got["train_label_end"] == date(2000, 1, 31)
    assert got["regime_probabilities"] == {0: pytest.approx(3 / 7), 1: pytest.approx(2 / 6), 2: pytest.approx(3 / 4)}


@pytest.mark.parametrize(("name", "most"), [("u2_mean_intervals", 0), ("u3_sharpe_difference", 1), ("c8_ci_envelope", 0), ("b6_performance_stats", 1)])
def test_queries_read_the_ticks_once(spark, name, most):
    """What a query uses more than once it has as files; its plan reads the ticks ``most`` times."""
    from barlab.jobs.registry import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= most


def test_candidates(spark):
    grid = wf.candidate_grid(spark).collect()
    assert len(grid) == 40 and len({r["id"] for r in grid}) == 40
    assert sum(r["family"] == "knn" for r in grid) == 18


def test_selection_ties_go_to_the_first_declared(spark):
    rows = [("X", date(1999, 5, d), date(1999, 5, d + 7), 1, c, 0.6) for d in (1, 2) for c in ("b", "a")] + [("X", date(2000, 5, 1), date(2000, 5, 8), 0, "a", 0.1)]
    df = spark.createDataFrame(rows, "symbol string, date date, label_end date, target int, candidate string, probability double")
    outer = spark.createDataFrame([(date(2000, 1, 1),)], "cutoff date")
    assert wf.select_from_past(df, outer, ["symbol"], ["b", "a"]).first()["selected"] == "b"


def board_rows(spark, predictions):
    """Rows of symbol X, all targets 1, in the order given: (candidate, year, probability)."""
    rows = [("X", date(y, 1, 1) + timedelta(i), c, 1, p) for i, (c, y, p) in enumerate(predictions)]
    return spark.createDataFrame(rows, "symbol string, date date, candidate string, target int, probability double").coalesce(1)


def places(rows):
    return [r["candidate"] for r in wf.leaderboard(rows, ["symbol"]).orderBy("place").collect()]


def test_equal_mean_accuracies_are_a_tie_however_they_add_up(spark):
    """Mean yearly accuracy is 0.45 for both, though 0.3 + 0.6 < 0.1 + 0.8 in doubles: the worst year decides, and with equal years the Brier score."""
    year = lambda c, y, right, p=0.6: [(c, y, p if i < right else 0.4) for i in range(10)]
    a, b = year("a", 1998, 1) + year("a", 1999, 8), year("b", 1998, 3) + year("b", 1999, 6)
    swapped = year("c", 1998, 6, 0.7) + year("c", 1999, 3, 0.7)
    assert places(board_rows(spark, a + b)) == ["b", "a"]
    assert places(board_rows(spark, a + b + swapped)) == ["c", "b", "a"]


def test_equal_losses_are_a_tie_in_any_order(spark):
    """Losses that come in another order have another sum in doubles; the name decides."""
    p = (0.6, 0.65, 0.9)
    assert places(board_rows(spark, [("a", 1998, x) for x in p] + [("b", 1998, x) for x in reversed(p)])) == ["a", "b"]


def test_the_board_is_the_plain_one(spark):
    got = wf.leaderboard(board_rows(spark, [("a", 1998, 0.6), ("a", 1998, 0.3), ("a", 1999, 0.9), ("b", 1998, float("nan"))]), ["symbol"]).orderBy("candidate").toPandas()
    assert list(got.columns) == ["symbol", "candidate", "total", "accuracy", "mean_year_accuracy", "worst_year_accuracy", "brier", "place"]
    np.testing.assert_allclose(got.loc[0, ["total", "accuracy", "mean_year_accuracy", "worst_year_accuracy", "brier"]].astype(float), [3, 2 / 3, 0.75, 0.5, (0.16 + 0.49 + 0.01) / 3], rtol=1e-15)
    assert np.isnan(got.loc[1, "brier"])


def test_bootstrap_sums_against_plain_indices(spark):
    n = 50
    v = np.arange(n) ** 1.5
    rows = spark.createDataFrame([("X", i, float(x)) for i, x in enumerate(v)], "symbol string, date int, v double")
    blocks = boot.circular_blocks(spark.createDataFrame([("X", n)], "symbol string, n long"), ["symbol"], block=8, reps=20, seed=5).toPandas()
    want = {rep: sum(v[(s + np.arange(z)) % n].sum() for s, z in zip(g["start"], g["size"])) for rep, g in blocks.groupby("rep")}
    got = {r["rep"]: r["v"] for r in boot.resampled_sums(rows, ["symbol"], ["v"], block=8, reps=20, seed=5).collect()}
    assert got == pytest.approx(want) and blocks.groupby("rep")["size"].sum().eq(n).all()


def test_serving_fails_closed(spark):
    b = spark.createDataFrame([("X", date(2000, 1, d), 10.0 + d) for d in range(1, 20)], "symbol string, date date, close double")
    oos = spark.createDataFrame([("X", date(2000, 1, 2), 0.7)], "symbol string, date date, probability double")
    art = lambda selected, p: spark.createDataFrame([("X", date(2000, 1, 5), date(2000, 1, 8), selected, p)], "symbol string, refit_date date, valid_until date, selected string, probability double")
    got = {r["date"].day: r for r in sv.research_forecast(b, oos, art("historical_prior", 0.6), 7).collect()}
    assert got[2]["mode"] == "historical" and got[2]["probability"] == 0.7
    assert [got[d]["mode"] for d in (4, 5, 7, 8)] == ["unavailable", "frozen", "frozen", "unavailable"]
    assert got[5]["realized"] == pytest.approx(22 / 15 - 1) and got[13]["realized"] is None
    assert {r["mode"] for r in sv.research_forecast(b, oos, art("logistic", 0.6), 7, history=False).collect()} == {"unavailable"}
    assert {r["mode"] for r in sv.research_forecast(b, oos, art("historical_prior", 1.5), 7, history=False).collect()} == {"unavailable"}
    with pytest.raises(ValueError):
        sv.forecast(b.withColumns({"open": F.col("close"), "score": F.lit(1)}), spark.createDataFrame([("X", 1, 0.5)], "symbol string, score int, probability double"), 9, start=date(2000, 1, 1))


def test_folds_never_train_on_open_labels(spark, bars):
    rows = lb.close_to_close(bars, 7).where("target IS NOT NULL")
    assert sv.fold_leaks(lb.folds_of(rows, wf.folds(spark, date(1997, 6, 1), date(1998, 1, 1)))).count() == 0
