"""Whitening of embeddings over a RowMatrix of exactly centred rows.

1. Entries become integers, x = floor(1024 c) + 100000, so that the count n and
   the sum S of every dimension are exact.
2. The rows (n x - S) / n are centred exactly: the numerator is an integer, and
   one division rounds. MLlib's computeGramianMatrix of these rows, divided by
   n, is the covariance; partial matrices are added up in a tree.
3. ``eigh`` of that matrix, whose size is the dimension's square whatever the
   rows, gives the components; mean and components are broadcast, and each row
   is projected in mapInPandas.
4. The whitened rows are written once; how far their covariance, centred and
   summed anew in the same way, is from the identity is measured on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barlab.llm.session import checkpointed

SCALE, SHIFT = 1024, 100_000
#: Eigenvalues below this share of the largest one are rounding errors of zero.
FLAT = 1e-12


@dataclass
class Whitening:
    """Rows and sums of the fit list, and its leading components (columns of ``directions``) with their eigenvalues; ``trace`` of the covariance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    @property
    def usable(self) -> np.ndarray:
        """Components along which the rows differ at all."""
        return self.values > FLAT * max(float(self.values.max(initial=0.0)), 0.0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exactly; an error where it leaves 64 bits."""
        gap = self.n * x - self.sums
        if len(gap) and float(np.abs(gap).max(initial=0)) ** 2 * gap.shape[1] >= 2.0**63:
            exact = [sum(int(v) ** 2 for v in row) for row in gap]
            if max(exact) >= 2**63:
                raise OverflowError("a deviation leaves 64 bits")
            return np.array(exact, np.int64)
        return (gap * gap).sum(axis=1)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; NaN along unusable components."""
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.where(self.usable, np.sqrt(np.abs(self.values)), np.nan)
            return ((self.n * x - self.sums) / self.n) @ self.directions / root


def integers(vector: Column) -> Column:
    """floor(1024 c) + 100000 of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def valid(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _sums(rows: DataFrame, column: str, kind: str) -> list:
    """Per dimension the sum of an array column, added up within each task before the shuffle: a row per dimension."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                own = np.stack(part[column].to_numpy()).sum(axis=0)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"dimension": np.arange(len(total)), "total": total})

    parts = rows.select(column).mapInPandas(add, f"dimension long, total {kind}")
    return [r["total"] for r in parts.groupBy("dimension").agg(F.sum("total").alias("total")).orderBy("dimension").collect()]


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of an array column of doubles, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _covariance(rows: DataFrame, column: str, sums: list, n: int) -> np.ndarray:
    """Covariance of an array column with divisor ``n``, of rows centred before multiplying."""
    centre = F.array(*[F.lit(s) for s in sums])
    centred = F.transform(F.arrays_zip(F.col(column).alias("x"), centre.alias("s")), lambda z: (n * z["x"] - z["s"]).cast("double") / n)
    return _gramian(rows.select(centred.alias("c")), "c") / n


def _length(fine: DataFrame, column: str) -> tuple[int, int]:
    """Length of most vectors (the larger of equally frequent ones), and how many have it."""
    sizes = fine.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (sizes["d"], sizes["count"]) if sizes else (0, 0)


def fit(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8) -> Whitening:
    """The whitening of all valid vectors of the most frequent length; only matrices of the dimension's size come to the driver."""
    fine = vectors.where(valid(F.col(vector_col))).select(integers(F.col(vector_col)).alias("x"))
    d, n = _length(fine, "x")
    if not n or not d:
        return Whitening(n, np.zeros(d, np.int64), np.zeros((d, 0)), np.zeros(0), 0.0)
    fine = fine.where(F.size("x") == d)
    sums = _sums(fine, "x", "long")
    cov = _covariance(fine, "x", sums, n)
    values, directions = np.linalg.eigh((cov + cov.T) / 2)
    lead = np.argsort(values)[::-1][: min(components, d)]
    return Whitening(n, np.array(sums, np.int64), directions[:, lead], values[lead], float(np.trace(cov)))


def whiten(vectors: DataFrame, *, vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """The rows of ``vectors`` with a valid vector, with n, deviation, whitened (array, by falling eigenvalue), explained (array) and identity_error.

    Rows whose vector is null, or holds a null or an entry that is not finite,
    go. All others are the fit list, repeated rows too, but for vectors of
    another length than most have (the larger of equally frequent ones): these
    stay, with null deviation and whitened. There are as many components as
    ``components`` and the dimension allow; along one on which all rows agree
    whitened is null. ``identity_error``: largest entry of the difference
    between whitened's covariance and the identity, over the other components.
    Columns of ``vectors`` with these names are replaced. An empty table, or
    one without a valid vector, gives no rows; vectors of length 0 get no
    components.
    """
    model = fit(vectors, vector_col=vector_col, components=components)
    new = {"deviation": T.LongType(), "whitened": T.ArrayType(T.DoubleType())}
    added = ["n", "explained", "identity_error", *new]
    own = [c for c in vectors.columns if c not in added]
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            same = np.array([len(v) == len(m.sums) for v in part["__x"]], bool)
            x = np.stack(part["__x"][same].to_numpy()).astype(np.int64) if same.any() else np.zeros((0, len(m.sums)), np.int64)
            found = iter(zip(m.deviations(x).tolist(), m.whiten(x).tolist(), strict=True))
            fitted = [next(found) if is_fit else (None, None) for is_fit in same]
            deviation, whitened = zip(*fitted, strict=True) if fitted else ((), ())
            values = [None if w is None else [None if v != v else v for v in w] for w in whitened]
            yield part.drop(columns="__x").assign(deviation=pd.array(deviation, "Int64"), whitened=pd.Series(values, part.index, object))

    fine = vectors.where(valid(F.col(f"`{vector_col}`"))).select(*[F.col(f"`{c}`") for c in own], integers(F.col(f"`{vector_col}`")).alias("__x"))
    schema = T.StructType([*fine.schema.fields[:-1], *[T.StructField(c, t) for c, t in new.items()]])
    done = checkpointed(fine.mapInPandas(project, schema))
    return done.withColumns({"n": F.lit(model.n).cast("long"), "explained": F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>"), "identity_error": F.lit(identity_error(done, model))})


def identity_error(done: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, over the usable components."""
    if not model.usable.any():
        return 0.0
    picked = F.array(*[F.get("whitened", F.lit(int(i))) for i in np.flatnonzero(model.usable)])
    rows = done.where("whitened IS NOT NULL").select(picked.alias("w"))
    cov = _covariance(rows, "w", _sums(rows, "w", "double"), model.n)
    return float(np.abs(cov - np.eye(len(cov))).max())


def by_component(done: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
    """A row for each row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    each = done.select(id_col, "n", "deviation", "identity_error", F.col("whitened").alias("__w"), F.posexplode("explained").alias("__i", "explained"))
    return each.select(id_col, (F.col("__i") + 1).cast("int").alias("component"), "n", "deviation", F.get("__w", F.col("__i")).alias("whitened"), "explained", "identity_error")
