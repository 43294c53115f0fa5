"""Nearest neighbours over training tables larger than a task.

The training rows of a fold are cut into blocks by their distance from a pivot,
the centre of the scaled features. Two rows are at least as far apart as their
distances from the pivot differ, so a test row that has found k neighbours in
the blocks at its own distance needs to look into another block only if that
lies within reach of the k-th. What a block gives for a test row is its k
nearest there; these lists merge into the k nearest of all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barlab.functions.storage import checkpointed
from barlab.operators.models import scaled
from barlab.operators.newton import in_folds


def nearest_in_block(train: np.ndarray, test: np.ndarray, k: int, slice_rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test row, training row and squared distance of the k nearest of each test row; of equal distances the first training rows."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    k = min(k, len(train))
    for a in range(0, len(test), slice_rows):
        some = test[a : a + slice_rows]
        far = np.zeros((len(some), len(train)))
        for j in range(train.shape[1]):
            far += (some[:, j, None] - train[None, :, j]) ** 2
        edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(far <= edge)
        order = np.lexsort((col, far[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        out.append((row + a, col, far[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def knn_pooled(rows: DataFrame, features: list[str], folds: list[tuple], *, k: int, order: tuple[str, ...] = ("date", "symbol"), least: int = 200, window_days: int | None = None, block_rows: int = 20_000, test_rows: int = 5_000, most_sent: int = 100_000) -> DataFrame:
    """cutoff, ``order`` and probability (ups + 1) / (k + 2) of the test rows of each (cutoff, next cutoff), from the k nearest of all training rows together.

    ``rows``: matured, with label_end, target, the features and ``order``,
    columns that tell rows apart and by which equal distances are ordered
    ("date" first). A fold with fewer than ``least`` or k training rows is not
    predicted. A task holds a block of about ``block_rows`` training rows and
    ``test_rows`` test rows; blocks are found by approximate quantiles and cut
    further by a hash where many rows lie at one distance.
    """
    order_ = list(order)
    x = F.array(*[F.col(c).cast("double") for c in features])
    read = checkpointed(rows.select(*order_, "label_end", F.col("target").cast("long").alias("target"), x.alias("x")))
    spread = in_folds(read, [c for c, _ in folds], window_days)
    each = [F.get("x", F.lit(i)) for i in range(len(features))]
    sd = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    fits = spread.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in each]).alias("center"), F.array(*[sd(c) for c in each]).alias("scale"))
    fits = checkpointed(fits.where(F.col("n") >= max(least, k)))  # a row per fold of the protocol
    z = scaled(F.col("x"), F.col("center"), F.col("scale"))
    radius = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v))
    placed = lambda df: df.join(F.broadcast(fits), "cutoff").select("cutoff", *order_, "target", z.alias("z")).withColumn("r", radius)
    bounds = F.array(*[F.struct(F.lit(c).cast("date").alias("cutoff"), F.lit(stop).cast("date").alias("stop")) for c, stop in folds])
    inside = F.filter(bounds, lambda f: (F.col("date") >= f["cutoff"]) & (F.col("date") < f["stop"]))
    asked = [f"q_{c}" for c in order_]
    test = placed(read.withColumn("__fold", F.explode(inside)).select("*", F.col("__fold.cutoff").alias("cutoff"))).select("cutoff", *[F.col(c).alias(q) for c, q in zip(order_, asked)], "z", "r")
    train = placed(spread)

    most = fits.agg(F.max("n")).first()[0] or 0
    bands = max(1, -(-most // block_rows))
    edges = train.groupBy("cutoff").agg(F.percentile_approx("r", F.array(*[F.lit(i / bands) for i in range(1, bands)]), 10 * bands).alias("edges")) if bands > 1 else fits.select("cutoff", F.array().cast("array<double>").alias("edges"))
    edges = checkpointed(edges)
    banded = lambda df: df.join(F.broadcast(edges), "cutoff").withColumn("band", F.size(F.filter("edges", lambda e: e < F.col("r")))).drop("edges")
    train, test = checkpointed(banded(train)), checkpointed(banded(test))
    blocks = train.groupBy("cutoff", "band").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("low"), F.max("r").alias("high")).withColumn("parts", F.ceil(F.col("rows") / block_rows).cast("int"))
    blocks = checkpointed(blocks)
    tests = test.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    chunks = max(1, -(-tests // test_rows))
    part = lambda by, n: F.pmod(F.xxhash64(*by), n).cast("int")
    sized = blocks.select("cutoff", "band", "parts")
    sent = lambda df: F.broadcast(df) if df.count() <= most_sent else df
    cut = train.join(sent(sized), ["cutoff", "band"]).withColumns({"part": part(order_, F.col("parts")), "chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))}).drop("parts", "r")
    types = dict(train.dtypes)
    schema = ", ".join(["cutoff date", *[f"{q} {types[c]}" for c, q in zip(order_, asked)], "far double", *[f"{c} {types[c]}" for c in order_], "target long"])
    at = ["cutoff", "band", "part", "chunk"]

    def search(_: tuple, own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        names = ["cutoff", *asked, "far", *order_, "target"]
        if not len(own) or not len(some):
            return pd.DataFrame(columns=names)
        own = own.sort_values(order_).reset_index(drop=True)
        i, j, far = nearest_in_block(np.stack(own["z"].to_numpy()), np.stack(some["z"].to_numpy()), k)
        found = own.iloc[j][[*order_, "target"]].reset_index(drop=True)
        told = some.iloc[i][["cutoff", *asked]].reset_index(drop=True)
        return pd.concat([told, pd.Series(far, name="far"), found], axis=1)[names]

    def nearest(wanted: DataFrame) -> DataFrame:
        """Neighbours in the blocks of the wanted bands."""
        spread_out = wanted.join(sent(sized), ["cutoff", "band"]).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "chunk": part(asked, F.lit(chunks))})
        return cut.groupBy(*at).cogroup(spread_out.drop("parts").groupBy(*at)).applyInPandas(search, schema)

    best = F.slice(F.array_sort(F.collect_list(F.struct("far", *order_, "target"))), 1, k)  # a test row's lists: k from each block it looked into
    home = checkpointed(nearest(test.select("cutoff", "band", "z", *asked)))
    reach = home.groupBy("cutoff", *asked).agg(best.alias("best")).select("cutoff", *asked, F.when(F.size("best") == k, F.sqrt(F.element_at("best", -1)["far"])).otherwise(float("inf")).alias("reach"))
    known = test.join(reach, ["cutoff", *asked], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    away = F.greatest(F.col("low") - F.col("r"), F.col("r") - F.col("high"), F.lit(0.0))
    # a hair of slack for the roots' rounding
    spans = blocks.groupBy("cutoff").agg(F.collect_list(F.struct("band", "low", "high")).alias("spans"))  # a fold's bands: its rows over block_rows
    others = known.join(F.broadcast(spans), "cutoff").withColumn("span", F.explode("spans")).where(F.col("span.band") != F.col("band"))
    others = others.select("cutoff", F.col("span.band").alias("band"), "z", *asked, "r", "reach", F.col("span.low").alias("low"), F.col("span.high").alias("high")).where(away <= F.col("reach") * (1 + 1e-12) + 1e-12)
    every = home.unionByName(nearest(others.select("cutoff", "band", "z", *asked))) if bands > 1 else home
    merged = every.groupBy("cutoff", *asked).agg(best.alias("best"))
    ups = F.aggregate("best", F.lit(0).cast("long"), lambda s, b: s + b["target"])
    return merged.select("cutoff", *[F.col(q).alias(c) for c, q in zip(order_, asked)], ((ups + 1) / (k + 2)).alias("probability"))
