"""Toxicity by subword-bag embeddings.

A word's vector is the mean of the vectors of its character n-grams, so a
misspelling that training never saw still shares most of them. The vectors of
a window of words are averaged into a linear softmax over (clean, toxic);
embeddings and softmax are trained together in numpy. A document is as toxic
as its worst window, which keeps a few words in a long text visible; a final
logistic curve turns the worst window's logit into a probability.

Labels mark documents, not windows: the first pass takes every window of a
toxic document as toxic, later passes only those that the model so far holds
for toxic, and none of a document where it finds nothing (a wrong label).

Training reads a bounded sample (one text for each of ``per_class`` ids of each
label, of at most ``sample_chars`` characters); scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from barlab.llm.kernels import Words, mix, powers, ranges, word_slices

GRAMS = (3, 4, 5, 6)
_OPEN, _CLOSE = 256, 257
_CODE = mix(np.arange(1 << 10, 1 << 11, dtype=np.uint64))


@dataclass
class Bags:
    """Distinct words as bags of buckets: flat ids, and the first of each word."""

    ids: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first, append=len(self.ids))


def subwords(words: Words, at: np.ndarray, bits: int) -> Bags:
    """Buckets of the character n-grams of ``<word>`` for the words at ``at``, and of the word itself."""
    lengths = (words.ends - words.starts)[at] + 2
    ends = np.cumsum(lengths)
    codes = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = inner[ends - lengths] = False
    codes[inner] = words.data[ranges(words.starts[at], lengths - 2)]
    codes[ends - lengths], codes[ends - 1] = _OPEN, _CLOSE
    owner = np.repeat(np.arange(len(at)), lengths)
    left = ends[owner] - np.arange(len(codes))  # codes to the word's end, this one included
    power, value, found, whose = powers(max(GRAMS)), np.zeros(len(codes), np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        value = value[: len(codes) - n + 1] + _CODE[codes[n - 1 :]] * power[n - 1]
        if n in GRAMS:
            fits = np.flatnonzero(left[: len(value)] >= n)
            found.append(mix(value[fits] + np.uint64(n)))
            whose.append(owner[fits])
    found.append(mix(words.hashes()[at] if len(at) else np.zeros(0, np.uint64)))
    whose.append(np.arange(len(at)))
    flat, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    ids = (flat[order] >> np.uint64(64 - bits)).astype(np.int64)
    return Bags(ids, np.searchsorted(whose[order], np.arange(len(at))))


def window_bounds(counts: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` words at every ``step``: first and end word (over all rows), and the row. Rows without words have none."""
    base = np.cumsum(counts) - counts
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - width) // step)), 0)
    row = np.repeat(np.arange(len(counts)), n)
    k = ranges(np.zeros(len(n), np.int64), n)
    start = base[row] + k * step
    return start, np.minimum(start + width, base[row] + counts[row]), row


def no_runs(rows: np.ndarray, n_rows: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``place`` without words equal to the one before them in their row, and the words left per row."""
    kept = np.ones(len(place), bool)
    kept[1:] = (np.diff(place) != 0) | (np.diff(rows) != 0)
    return place[kept], np.bincount(rows[kept], minlength=n_rows).astype(np.int64)


def bag_corpus(texts: list[str], bits: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, Bags]:
    """Words of all texts as places among the distinct ones, words per text (runs of one word count once), and the distinct words' bags; by slices, so what is held beside them is small."""
    seen = np.zeros(0, np.uint64)
    hashes, rows, ids, sizes = [], [], [], []
    for a, _, words in word_slices(pa.array(texts, pa.string()), most=most):
        own = words.hashes()
        unique, first = np.unique(own, return_index=True)
        new = ~np.isin(unique, seen)
        bags = subwords(words, first[new], bits)
        ids.append(bags.ids.astype(np.int32))
        sizes.append(bags.sizes)
        seen = np.concatenate((seen, unique[new]))
        hashes.append(own)
        rows.append((words.rows + a).astype(np.int32))
    order = np.argsort(seen)
    ranked, places = seen[order], [np.zeros(0, np.int32)]
    while hashes:  # slice by slice, each freed as it goes
        places.append(order[np.searchsorted(ranked, hashes.pop(0))].astype(np.int32))
    place = np.concatenate(places)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    place, counts = no_runs(np.concatenate(rows) if rows else np.zeros(0, np.int32), len(texts), place)
    return place, counts, Bags(np.concatenate(ids) if ids else np.zeros(0, np.int32), np.cumsum(size) - size)


@dataclass
class Model:
    """``weights``: each bucket's share in the toxic logit (embedding times softmax)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int
    width: int

    def worst(self, words: Words, rows: int) -> np.ndarray:
        """The largest window logit of each row; the bias for rows without words."""
        out = np.full(rows, self.bias)
        if len(words.starts):
            _, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
            bags = subwords(words, first, self.bits)
            share = np.add.reduceat(self.weights[bags.ids], bags.first) / bags.sizes
            place, counts = no_runs(words.rows, rows, place)
            total = np.concatenate(([0.0], np.cumsum(share[place])))
            start, end, row = window_bounds(counts, self.width, max(1, self.width // 2))
            logit = self.bias + (total[end] - total[start]) / (end - start)
            at = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[at]] = np.maximum.reduceat(logit, at)
        return out

    def score(self, words: Words, rows: int) -> np.ndarray:
        z = self.slope * self.worst(words, rows) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _segment_sum(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.add.reduceat(values[order], at, axis=0)


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, *, bits: int = 17, dim: int = 8, width: int = 4, phases: int = 3, updates: int = 300, epochs: tuple[int, int] = (2, 12), rate: float = 0.5, batch: int = 3000, seed: int = 7) -> Model:
    """Fit embeddings and softmax together by Adagrad on windows, then the curve of the worst windows.

    Each of the ``phases`` goes over its windows for about ``updates`` batches,
    that is a number of times between the two ``epochs``, and the next one
    chooses its toxic windows anew.

    ``weight``: how many documents a sampled one stands for. With one class
    only, or none, the model gives that class's share for every text.
    """
    rng = np.random.default_rng(seed)
    share = float((weight * toxic).sum() / weight.sum()) if len(texts) else 0.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if not len(texts) or toxic.min() == toxic.max():
        return Model(np.zeros(1 << bits, np.float32), base, 1.0, 0.0, bits, width)
    place, counts, bags = bag_corpus(texts, bits)
    start, end, row = (x.astype(np.int32) for x in window_bounds(counts, width, width))
    scale = np.where(toxic[row] == 1, (toxic == 0).sum() / max(1, (toxic == 1).sum()), 1.0)
    table = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (dim, 2))
    bias = np.zeros(2)
    seen_t, seen_s, seen_b = np.full(1 << bits, 1e-6), np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    label = toxic[row].astype(np.int8)
    use = np.ones(len(row), bool)

    def model(slope: float = 1.0, shift: float = 0.0) -> Model:
        return Model((table @ (soft[:, 1] - soft[:, 0])), float(bias[1] - bias[0]), slope, shift, bits, width)

    def logits() -> np.ndarray:
        m = model()
        part = np.add.reduceat(m.weights[bags.ids], bags.first) / bags.sizes
        out = np.empty(len(start))
        for a in range(0, len(start), 1 << 18):  # windows lie side by side, so a block of them is a run of words
            b = min(a + (1 << 18), len(start))
            out[a:b] = np.add.reduceat(part[place[start[a] : end[b - 1]]], start[a:b] - start[a]) / (end[a:b] - start[a:b])
        return m.bias + out

    def step(pick: np.ndarray) -> None:
        n = end[pick] - start[pick]
        flat = place[ranges(start[pick], n)]
        own, back = np.unique(flat, return_inverse=True)
        size = bags.sizes[own]
        ids = bags.ids[ranges(bags.first[own], size)]
        lead = np.cumsum(size) - size
        vectors = np.add.reduceat(table[ids], lead, axis=0) / size[:, None]
        hidden = np.add.reduceat(vectors[back], np.cumsum(n) - n, axis=0) / n[:, None]
        z = hidden @ soft + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(pick)), label[pick]] -= 1
        g = p * (scale[pick] / scale[pick].sum())[:, None]
        grad_h = g @ soft.T / n[:, None]
        grad_s, grad_b = hidden.T @ g, g.sum(axis=0)
        _, grad_w = _segment_sum(np.repeat(grad_h, n, axis=0), back)
        key, grad_t = _segment_sum(np.repeat(grad_w / size[:, None], size, axis=0), ids)
        seen_t[key] += (grad_t**2).mean(axis=1)
        table[key] -= rate * grad_t / np.sqrt(seen_t[key])[:, None]
        np.add(seen_s, grad_s**2, out=seen_s)
        np.subtract(soft, 0.1 * grad_s / np.sqrt(seen_s), out=soft)
        np.add(seen_b, grad_b**2, out=seen_b)
        np.subtract(bias, 0.1 * grad_b / np.sqrt(seen_b), out=bias)

    for k in range(phases):
        if k:
            z = logits()
            edge = np.quantile(z[toxic[row] == 0], 0.995)
            use = (toxic[row] == 0) | (z > edge)
            seen_t[:], seen_s[:], seen_b[:] = seen_t / 4, seen_s / 4, seen_b / 4
        times = int(np.clip(round(updates * batch / max(1, use.sum())), *epochs))
        for _ in range(times):
            order = rng.permutation(np.flatnonzero(use))
            for a in range(0, len(order), batch):
                step(order[a : a + batch])
    last = model()
    worst = np.concatenate([last.worst(w, b - a) for a, b, w in word_slices(pa.array(texts, pa.string()))])
    slope, shift = _curve(worst, toxic, weight)
    return model(slope, shift)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable (Newton, slightly ridged)."""
    mid, wide = float(x.mean()), float(x.std()) or 1.0
    design = np.stack(((x - mid) / wide, np.ones_like(x)), axis=1)
    beta = np.zeros(2)
    w = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        g = design.T @ (w * (p - y)) + 1e-2 * beta
        h = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        move = np.linalg.solve(h, g)
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0] / wide), float(beta[1] - beta[0] * mid / wide)


def training_sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, sample_chars: int = 20_000) -> DataFrame:
    """__pick (id), text, toxic and weight of at most ``per_class`` labelled ids of each class, in the order of a hash of their ids; a row for each.

    The bound: 2 x per_class rows of at most sample_chars characters each,
    however ids and rows repeat. An id stands for one text of at most
    ``sample_chars`` characters, the one with the smallest hash; longer, null
    and unlabelled texts are left out of training only. A weight is how many
    such ids one stands for. Without labels or documents there are no rows.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("toxic"))
    usable = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= sample_chars).withColumn("__hash", F.xxhash64("text"))
    chosen = usable.groupBy("__doc").agg(F.min("__hash").alias("__hash"))  # combines before the shuffle, so a repeated id costs a row a task
    known = chosen.join(marks, F.col("__doc") == F.col("__id")).select("__doc", "__hash", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picks = None
    for mark in (0, 1):
        n = counts.get(mark, 0)
        own = known.where(F.col("toxic") == mark).orderBy(F.xxhash64("__doc"), "__doc").limit(per_class).select(F.col("__doc").alias("__pick"), F.col("__hash").alias("__text"), "toxic", F.lit(n / max(1, min(n, per_class))).alias("weight"))
        picks = own if picks is None else picks.union(own)
    found = usable.join(F.broadcast(picks), (F.col("__doc") == F.col("__pick")) & (F.col("__hash") == F.col("__text")))
    return found.groupBy("__pick", "toxic", "weight").agg(F.min("text").alias("text")).select("__pick", "text", "toxic", "weight")


def fit(sample: DataFrame, bits: int = 17, width: int = 4) -> Model:
    """A model of the sample, trained in one task; only the weights come to the driver."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__pick", "text"])
        m = train(rows["text"].tolist(), rows["toxic"].to_numpy(np.int64), rows["weight"].to_numpy(float), bits=bits, width=width)
        return pd.DataFrame({"weights": [m.weights.astype(np.float32).tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    row = sample.groupBy().applyInPandas(run, "weights binary, bias double, slope double, shift double").first()
    if row is None:
        return train([], np.zeros(0, np.int64), np.zeros(0), bits=bits, width=width)
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"], row["slope"], row["shift"], bits, width)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text in ``score_col``, replaced if there; a null or empty text gets the score of no evidence.

    Rows are independent: repeats get the same score, other columns pass
    through, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != score_col]
    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            for a, b, words in word_slices(text):
                found = shared.value.score(words, b - a)
                yield pa.RecordBatch.from_arrays([*[x.slice(a, b - a) for x in batch.columns], pa.array(found)], [*own, score_col])

    return docs.select(*own).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000, sample_chars: int = 20_000, held_out=None, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with a score and what it predicts (1 if it is 0.5 or more), by a model trained on the labelled documents outside ``held_out``.

    The score depends on the text alone. Several labels of one id count as
    toxic if any is; null labels and ids train nothing. Every row gets a
    score, repeated rows the same one; an empty table gives no rows; a column
    of ``docs`` named as one of the two new ones is replaced. Without labels
    of both kinds every text gets the share of toxic ones among the labels
    (0.001 at least), so nothing is predicted toxic without a toxic label.
    """
    learn = docs if held_out is None else docs.where(~held_out)
    model = fit(training_sample(learn, labels, id_col=id_col, text_col=text_col, label_col=label_col, per_class=per_class, sample_chars=sample_chars))
    return score(docs.drop(predicted_col), model, text_col=text_col, score_col=score_col).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))
