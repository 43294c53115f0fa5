"""Nearest neighbours in blocks against the plain search, and pairs of model versions."""

from datetime import date, timedelta

import numpy as np
import pytest

from barlab.operators import labels as lb, models as md, nearest

D0 = date(2000, 1, 1)


def rows_of(spark, n=400, seed=2, symbols="XY", d=3):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        x = np.round(rng.normal(0, 1, (n, d)), 1)  # ties
        x[:40] = x[0]
        out += [(s, D0 + timedelta(i), D0 + timedelta(i + 7), int(rng.random() < 0.5), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(out, "symbol string, date date, label_end date, target int, " + ", ".join(f"f{i} double" for i in range(d)))


def brute(rows, names, folds, k, window=None):
    data = rows.toPandas().sort_values(["date", "symbol"]).reset_index(drop=True)
    x, y = data[names].to_numpy(float), data["target"].to_numpy(float)
    out = {}
    for cutoff, stop in folds:
        use = np.array([e < cutoff and (window is None or d >= cutoff - timedelta(window)) for e, d in zip(data["label_end"], data["date"])])
        if use.sum() < max(200, k):
            continue
        center, scale = x[use].mean(axis=0), x[use].std(axis=0)
        z = np.clip((x - center) / np.where(scale == 0, 1, scale), -8, 8)
        for i in np.flatnonzero([(cutoff <= d < stop) for d in data["date"]]):
            far = ((z[use] - z[i]) ** 2).sum(axis=1)
            best = np.argsort(np.round(far, 9), kind="stable")[:k]
            out[cutoff, data["date"][i], data["symbol"][i]] = (y[use][best].sum() + 1) / (k + 2)
    return out


@pytest.mark.parametrize(("block_rows", "test_rows"), [(20_000, 5_000), (37, 20)])
def test_pooled_neighbours_equal_the_plain_search(spark, block_rows, test_rows):
    rows, names = rows_of(spark), ["f0", "f1", "f2"]
    folds = [(D0 + timedelta(60), D0 + timedelta(120)), (D0 + timedelta(200), D0 + timedelta(260)), (D0 + timedelta(300), D0 + timedelta(320))]
    got = {(r.cutoff, r.date, r.symbol): r.probability for r in nearest.knn_pooled(rows, names, folds, k=15, window_days=150, block_rows=block_rows, test_rows=test_rows).collect()}
    want = brute(rows, names, folds, 15, 150)
    assert got.keys() == want.keys() and len({c for c, _, _ in got}) == 2
    # equal distances up to rounding may swap two neighbours
    assert sum(got[k] != pytest.approx(want[k]) for k in want) <= len(want) // 50


def test_nearest_in_a_block_is_exact_with_ties():
    rng = np.random.default_rng(1)
    train, test = rng.integers(0, 4, (90, 2)).astype(float), rng.integers(0, 4, (25, 2)).astype(float)
    i, j, far = nearest.nearest_in_block(train, test, 7, slice_rows=4)
    for t in range(25):
        d = ((train - test[t]) ** 2).sum(axis=1)
        order = np.argsort(d, kind="stable")[:7]
        assert j[i == t].tolist() == order.tolist() and far[i == t].tolist() == d[order].tolist()
    assert len(nearest.nearest_in_block(train, test[:0], 7)[0]) == 0 and len(nearest.nearest_in_block(train[:3], test, 7)[0]) == 75
    y = rng.integers(0, 2, 90).astype(float)
    shares = md.nearest_shares(train, y, test, [7])[:, 0]
    assert shares == pytest.approx([(y[j[i == t]].sum() + 1) / 9 for t in range(25)])


def test_no_training_no_neighbours(spark):
    assert nearest.knn_pooled(rows_of(spark, n=50), ["f0"], [(D0, D0 + timedelta(9))], k=5).collect() == []


def test_versions_must_share_rows_and_targets(spark):
    make = lambda rows: spark.createDataFrame(rows, "symbol string, date date, target int, probability double")
    a = make([("X", D0, 1, 0.4), ("X", D0 + timedelta(1), 0, 0.6)])
    got = lb.paired_versions(a, make([("X", D0 + timedelta(1), 0, 0.2), ("X", D0, 1, 0.9)]), ["symbol", "date"]).orderBy("date").collect()
    assert [(r.target, r.probability, r.other) for r in got] == [(1, 0.4, 0.9), (0, 0.6, 0.2)]
    for other, what in ((make([("X", D0, 1, 0.9)]), "only one version"), (make([("X", D0, 1, 0.9), ("X", D0 + timedelta(1), 1, 0.2)]), "targets differ")):
        with pytest.raises(Exception, match=what):
            lb.paired_versions(a, other, ["symbol", "date"]).collect()
