"""Fitted candidates: scaling, logistic regression, nearest neighbours, blends.

The two helpers see one symbol's rows at a time, once, and walk through all of
its folds as slices, so no training row is copied for a fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CLIP = 8.0


def scale_params(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Mean and population deviation (0 becomes 1) of each feature over the training rows of a fold."""
    sd = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    return rows.groupBy(*keys).agg(F.array(*[F.avg(c) for c in features]).alias("center"), F.array(*[sd(c) for c in features]).alias("scale"))


def scaled(features: Column, center: Column, scale: Column) -> Column:
    """Standard scores, clipped to +-8."""
    z = F.zip_with(F.zip_with(features, center, lambda x, c: x - c), scale, lambda d, s: d / s)
    return F.transform(z, lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x)))


def logistic_probability(z: Column, coefficients: Column) -> Column:
    """Sigmoid of intercept + z * beta, the exponent clipped to +-50. ``coefficients``: intercept first."""
    dot = F.aggregate(F.zip_with(z, F.slice(coefficients, 2, F.size(z)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + F.get(coefficients, F.lit(0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), dot))))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, tolerance: float = 1e-7, steps: int = 100) -> np.ndarray:
    """Minimum of mean log loss + penalty / 2 * |beta|^2 with a free intercept; no convergence is an error."""
    design = np.column_stack((np.ones(len(x)), x))
    ridge = np.full(design.shape[1], penalty)
    ridge[0] = 0.0
    beta = np.zeros(design.shape[1]) if start is None else start.copy()
    if start is None:
        beta[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    loss = lambda b: np.mean(np.logaddexp(0, design @ b) - y * (design @ b)) + 0.5 * (ridge * b * b).sum()
    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        gradient = design.T @ (p - y) / len(y) + ridge * beta
        if np.abs(gradient).max() < tolerance:
            return beta
        hessian = (design * (p * (1 - p) / len(y))[:, None]).T @ design + np.diag(ridge + 1e-12)
        move = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-8 and loss(beta - size * move) > now - 1e-4 * size * (gradient @ move):
            size /= 2
        beta = beta - size * move
        now = loss(beta)
    raise ArithmeticError("the logistic fit did not converge")


def _fold_slices(rows: pd.DataFrame, cutoffs: list, window_days: int | None) -> list[tuple[object, np.ndarray]]:
    """Training rows of each cutoff: matured before it, and inside the window if there is one."""
    ends, days = rows["label_end"].to_numpy("datetime64[D]"), rows["date"].to_numpy("datetime64[D]")
    out = []
    for c in cutoffs:
        c64 = np.datetime64(c, "D")
        use = ends < c64
        if window_days is not None:
            use &= days >= c64 - np.timedelta64(window_days, "D")
        out.append((c, np.flatnonzero(use)))
    return out


def logistic_folds(rows: DataFrame, keys: list[str], features: list[str], cutoffs: list, *, penalty: float, least: int = 365, window_days: int | None = None) -> DataFrame:
    """center, scale and coefficients for each cutoff with at least ``least`` training rows. ``rows``: matured, with date, label_end, target."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", cutoff date, train_rows long, train_label_end date, center array<double>, scale array<double>, coefficients array<double>"

    def group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x, y = part[features].to_numpy(float), part["target"].to_numpy(float)
        found, beta = [], None
        for cutoff, at in _fold_slices(part, cutoffs, window_days):
            if len(at) < least:
                continue
            center, scale = _scaling(x[at])
            beta = fit_logistic(np.clip((x[at] - center) / scale, -CLIP, CLIP), y[at], penalty, beta)
            found.append((*key, cutoff, len(at), part["label_end"].iloc[at].max(), center.tolist(), scale.tolist(), beta.tolist()))
        return pd.DataFrame(found, columns=[*keys, "cutoff", "train_rows", "train_label_end", "center", "scale", "coefficients"])

    return rows.select(*keys, "date", "label_end", "target", *features).groupBy(*keys).applyInPandas(group, schema)


def _scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    return center, scale


def nearest_shares(train: np.ndarray, y: np.ndarray, test: np.ndarray, counts: list[int], block: int = 256) -> np.ndarray:
    """(ups + 1) / (k + 2) of the k nearest training rows for each k, a column each; of equal distances the earlier rows count."""
    out = np.empty((len(test), len(counts)))
    for a in range(0, len(test), block):
        some = test[a : a + block]
        far = np.zeros((len(some), len(train)))
        for j in range(train.shape[1]):  # sums of squared differences: equal rows are exactly equally far
            far += (some[:, j, None] - train[None, :, j]) ** 2
        for c, k in enumerate(counts):
            edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
            inside = far < edge
            tied = far == edge
            inside |= tied & (np.cumsum(tied, axis=1) <= k - inside.sum(axis=1, keepdims=True))
            out[a : a + block, c] = (inside @ y + 1) / (k + 2)
    return out


def knn_folds(rows: DataFrame, keys: list[str], features: list[str], folds: list[tuple], *, k: int, least: int = 200, window_days: int | None = None) -> DataFrame:
    """Probability (ups + 1) / (k + 2) of the k nearest training rows, ties to the earlier date, for the test rows of each (cutoff, next cutoff)."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", cutoff date, date date, probability double"

    def group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date").reset_index(drop=True)
        x, y = part[features].to_numpy(float), part["target"].to_numpy(float)
        out = [pd.DataFrame(columns=[*keys, "cutoff", "date", "probability"])]
        for cutoff, train, test in _tests(part, folds, window_days):
            if len(train) >= max(least, k) and len(test):
                center, scale = _scaling(x[train])
                z = np.clip((x - center) / scale, -CLIP, CLIP)
                p = nearest_shares(z[train], y[train], z[test], [k])[:, 0]
                out.append(pd.DataFrame({**dict(zip(keys, key)), "cutoff": cutoff, "date": part["date"].iloc[test], "probability": p}))
        return pd.concat(out[1:] or out)

    return rows.select(*keys, "date", "label_end", "target", *features).groupBy(*keys).applyInPandas(group, schema)


def _tests(part: pd.DataFrame, folds: list[tuple], window_days: int | None) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """Training and test rows of each (cutoff, next cutoff)."""
    days = part["date"].to_numpy("datetime64[D]")
    for (cutoff, train), (_, stop) in zip(_fold_slices(part, [c for c, _ in folds], window_days), folds, strict=True):
        yield cutoff, train, np.flatnonzero((days >= np.datetime64(cutoff, "D")) & (days < np.datetime64(stop, "D")))


def fitted_candidates(rows: DataFrame, keys: list[str], specs: list[tuple], sets: dict[str, tuple[str, ...]], folds: list[tuple], *, least: int = 200) -> DataFrame:
    """keys, date, candidate, probability of all logistic and nearest-neighbour candidates over all folds (cutoff, next cutoff).

    ``specs``: rows of walkforward.GRID. Candidates of one family, window and
    feature set share a group, so a symbol's rows go to a group for each of
    these and are scaled once per fold for all penalties or neighbour counts.
    A fold with fewer than ``least`` training rows, or fewer than neighbours,
    is not predicted.
    """
    jobs: dict[str, list[tuple]] = {}
    for s in specs:
        if s[1] in ("logistic", "knn"):
            jobs.setdefault(f"{s[1]}|{s[2]}|{s[3]}", []).append(s)
    names = sorted({c for k in {s[3] for v in jobs.values() for s in v} for c in sets[k]})
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", date date, candidate string, probability double"

    def group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *own, job = key
        _, family, window, kind, _, _ = jobs[job][0]
        part = part.sort_values("date").reset_index(drop=True)
        x, y = part[list(sets[kind])].to_numpy(float), part["target"].to_numpy(float)
        out = [pd.DataFrame(columns=[*keys, "date", "candidate", "probability"])]
        betas: dict[str, np.ndarray] = {}
        for _, train, test in _tests(part, folds, window):
            if len(train) < least or not len(test):
                continue
            center, scale = _scaling(x[train])
            z = np.clip((x - center) / scale, -CLIP, CLIP)
            found = {}
            if family == "knn":
                fit = [s for s in jobs[job] if s[5] <= len(train)]
                shares = nearest_shares(z[train], y[train], z[test], [s[5] for s in fit])
                found = {s[0]: shares[:, i] for i, s in enumerate(fit)}
            else:
                for s in jobs[job]:
                    betas[s[0]] = fit_logistic(z[train], y[train], s[4], betas.get(s[0]))
                    found[s[0]] = 1 / (1 + np.exp(-np.clip(betas[s[0]][0] + z[test] @ betas[s[0]][1:], -50, 50)))
            for name, p in found.items():
                out.append(pd.DataFrame({**dict(zip(keys, own)), "date": part["date"].iloc[test], "candidate": name, "probability": p}))
        return pd.concat(out[1:] or out)

    spread = rows.select(*keys, "date", "label_end", "target", *names).withColumn("__job", F.explode(F.array(*[F.lit(j) for j in sorted(jobs)])))
    return spread.groupBy(*keys, "__job").applyInPandas(group, schema)


def blends(df: DataFrame, weight: float = 0.5) -> DataFrame:
    """always_up, coin_flip, logistic_shrunk (``weight`` of the prior, the rest of the logistic) and equal_blend (the mean of regime and logistic_shrunk)."""
    shrunk = weight * F.col("prior") + (1 - weight) * F.col("logistic")
    return df.withColumns({"always_up": F.lit(1.0), "coin_flip": F.lit(0.5), "logistic_shrunk": shrunk, "equal_blend": (F.col("regime") + shrunk) / 2})
