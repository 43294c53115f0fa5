"""Logistic fits of all folds at once, on training sets larger than a task.

A step is one aggregate over the rows: for each fold the sums of the loss, its
gradient and its Hessian, which combine before the shuffle. What is left for a
fold is a system of as many equations as features, solved where its sums
arrive. No row is gathered, none is shuffled where the folds' parameters are
few enough to be sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barlab.functions.storage import checkpointed
from barlab.operators.models import CLIP

#: Folds (keys x cutoffs) up to which their parameters are broadcast: some hundred bytes each.
MOST_SENT = 100_000


def in_folds(rows: DataFrame, cutoffs: list, window_days: int | None) -> DataFrame:
    """Each row with the cutoffs of the folds that it trains: matured before them, and inside the window if there is one."""
    days = F.array(*[F.lit(c).cast("date") for c in cutoffs])
    inside = lambda c: (F.col("label_end") < c) & (F.lit(True) if window_days is None else F.col("date") >= F.date_sub(c, window_days))
    return rows.withColumn("cutoff", F.explode(F.filter(days, inside)))


def _sums(d: int) -> tuple[Column, list[Column]]:
    """The exponent, and sums over rows of the loss, its gradient g_i and its Hessian h_i_j (intercept first), at the trial coefficients."""
    z = [F.lit(1.0), *[F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.get("x", F.lit(i)) - F.get("center", F.lit(i))) / F.get("scale", F.lit(i)))) for i in range(d)]]
    eta = sum((F.get("trial", F.lit(i + 1)) * z[i + 1] for i in range(d)), F.get("trial", F.lit(0)))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("__eta")))))
    e = F.col("__eta")
    loss = F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e))) - F.col("target") * e
    miss, weight = p - F.col("target"), p * (1 - p)
    out = [F.sum(loss).alias("loss_sum"), *[F.sum(miss * z[i]).alias(f"g_{i}") for i in range(d + 1)]]
    return eta, out + [F.sum(weight * z[i] * z[j]).alias(f"h_{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]


def _advance(d: int, penalty: float, tolerance: float):
    """One step of each fold: accept the trial if the loss fell enough and take a new direction, else halve the step."""
    ridge = np.r_[0.0, np.full(d, penalty)]

    def one(r) -> tuple:
        trial, n = np.array(r.trial), r.train_rows
        loss = r.loss_sum / n + 0.5 * (ridge * trial * trial).sum()
        enough = r.loss is None or np.isnan(r.loss) or loss <= r.loss - 1e-4 * r.size * r.slope + 1e-14 * max(1.0, abs(r.loss))
        if not enough and r.size > 1e-8:
            size = r.size / 2
            return list(r.beta), (np.array(r.beta) - size * np.array(r.move)).tolist(), list(r.move), r.loss, size, r.slope, False
        gradient = np.array([getattr(r, f"g_{i}") for i in range(d + 1)]) / n + ridge * trial
        if np.abs(gradient).max() < tolerance:
            return trial.tolist(), trial.tolist(), [0.0] * (d + 1), loss, 0.0, 0.0, True
        hessian = np.diag(ridge + 1e-12)
        for i in range(d + 1):
            for j in range(i, d + 1):
                hessian[i, j] += getattr(r, f"h_{i}_{j}") / n
                hessian[j, i] = hessian[i, j]
        move = np.linalg.solve(hessian, gradient)
        return trial.tolist(), (trial - move).tolist(), move.tolist(), loss, 1.0, float(gradient @ move), False

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = pd.DataFrame([one(r) for r in part.itertuples()], columns=_STATE, index=part.index)
            yield pd.concat([part[[c for c in part.columns if c not in (*_STATE, "loss_sum") and c[:2] not in ("g_", "h_")]], found], axis=1)

    return run


_STATE = ["beta", "trial", "move", "loss", "size", "slope", "done"]
_STATE_DDL = "beta array<double>, trial array<double>, move array<double>, loss double, size double, slope double, done boolean"


def newton_folds(rows: DataFrame, keys: list[str], features: list[str], cutoffs: list, *, penalty: float, least: int = 365, window_days: int | None = None, tolerance: float = 1e-10, steps: int = 60) -> DataFrame:
    """center, scale and coefficients for each key and cutoff with at least ``least`` training rows, as models.logistic_folds gives them.

    ``rows``: matured, with date, label_end, target and the features; ``keys``
    may be empty, for folds over all symbols together. Minimum of mean log
    loss + penalty / 2 * |beta|^2 with a free intercept, by Newton steps that
    are halved until the loss falls; a fold that does not come to a gradient
    below ``tolerance`` in ``steps`` passes is an error.
    """
    d = len(features)
    x = F.array(*[F.col(c).cast("double") for c in features])
    read = checkpointed(rows.select(*keys, "date", "label_end", F.col("target").cast("double").alias("target"), x.alias("x")))
    spread = in_folds(read, cutoffs, window_days)
    each = [F.get("x", F.lit(i)) for i in range(d)]
    sd = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    base = spread.groupBy(*keys, "cutoff").agg(
        F.count(F.lit(1)).alias("train_rows"), F.max("label_end").alias("train_label_end"), F.sum("target").alias("ups"), F.array(*[F.avg(c) for c in each]).alias("center"), F.array(*[sd(c) for c in each]).alias("scale")
    )
    start = F.array(F.log((F.col("ups") + 1) / (F.col("train_rows") - F.col("ups") + 1)), *[F.lit(0.0)] * d)
    none = F.lit(None).cast("double")
    state = base.where(F.col("train_rows") >= least).withColumns({"beta": start, "trial": start, "move": F.array(*[F.lit(0.0)] * (d + 1)), "loss": none, "size": F.lit(0.0), "slope": F.lit(0.0), "done": F.lit(False)})
    state = checkpointed(state.drop("ups"))
    names = [c for c in state.columns if c not in _STATE]
    ddl = ", ".join(f"`{c}` {t}" for c, t in state.dtypes if c in names) + ", " + _STATE_DDL
    eta, sums = _sums(d)
    ready = None
    for _ in range(steps):
        open_, done = state.where(~F.col("done")), state.where("done")
        ready = done if ready is None else ready.unionByName(done)
        count = open_.count()
        if not count:
            return ready.select(*keys, "cutoff", "train_rows", "train_label_end", "center", "scale", F.col("beta").alias("coefficients"))
        needed = open_.select(*keys, "cutoff", "center", "scale", "trial")
        met = spread.join(F.broadcast(needed) if count <= MOST_SENT else needed, [*keys, "cutoff"])
        found = met.withColumn("__eta", eta).groupBy(*keys, "cutoff").agg(*sums)
        state = checkpointed(open_.join(found, [*keys, "cutoff"]).mapInPandas(_advance(d, penalty, tolerance), ddl))
    raise ArithmeticError("a logistic fit did not converge")
