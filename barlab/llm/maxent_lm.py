"""Scoring by a hashed maximum-entropy language model.

    P(token | history) = P(class | history) * P(token | class, history)

* Classes: the ``vocab`` most frequent words are clustered by their frequent
  neighbours; all other words are one class, the end of a text another.
* P(class | history): a softmax over classes whose features are hashed: the
  word before, the word before that (skip), and both together. Tasks run
  gradient updates over their tokens from the same start; the weights of a
  feature are averaged by how often each task met it.
* P(word | class, history): a softmax over the class's words with the classes
  of the two words before as n-gram and skip features. Its gradient needs only
  counts of (class before, word) and of class triples, which Spark sums over
  the corpus; each class is fitted in a task of its own.
* A word outside the vocabulary has its share (count + 1) of that class.

What a task or the driver holds is bounded by the model's parameters; the
corpus' counts stay in Spark and are joined. Scoring gathers weights for
batches of tokens (sparse rows) in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlab.llm.kernels import Seen, Words, mix, word_slices
from barlab.llm.session import checkpointed

END = np.uint64(0x3C6EF372FE94F82B)  # the fingerprint of the end token


@dataclass(frozen=True)
class Shape:
    """Sizes of the model, the smallest by default. ``table``: words whose counts every task holds; rarer ones are joined."""

    vocab: int = 4096
    table: int = 1 << 17
    classes: int = 32
    neighbours: int = 64
    bits: int = 13
    batch: int = 8192
    rate: float = 0.3
    fit_steps: int = 25

    @classmethod
    def of_corpus(cls, total: int, distinct: int) -> Shape:
        """Sizes that grow with the corpus: buckets with the root of its tokens (while there are words to tell apart), words with a class-conditional probability as half the buckets, classes with the root of those."""
        bits = max(cls.bits, min(round(np.log2(max(total, 1)) / 2), int(distinct).bit_length()))
        more = 2.0 ** (bits - cls.bits)
        vocab = int(cls.vocab * more)
        return cls(vocab=vocab, table=max(cls.table, vocab), classes=round(cls.classes * more**0.5), bits=bits)

    @property
    def outcomes(self) -> int:
        """Classes of words, the class of other words, the end."""
        return self.classes + 2

    @property
    def contexts(self) -> int:
        """Outcomes and the beginning of a text."""
        return self.classes + 3

    @property
    def features(self) -> int:
        return (1 << self.bits) * 4 + 1


@dataclass
class Tokens:
    """Tokens of some rows, ends included: fingerprint, rank (-1: not in the table), row, place in the row."""

    hashes: np.ndarray
    rank: np.ndarray
    row: np.ndarray
    place: np.ndarray
    end: np.ndarray


def tokens(words: Words, index: Seen | None) -> Tokens:
    counts = words.counts + 1
    last = np.cumsum(counts) - 1
    total = int(counts.sum())
    end = np.zeros(total, bool)
    end[last] = True
    hashes = np.full(total, END, np.uint64)
    hashes[~end] = words.hashes()
    rank = np.full(total, -1, np.int64)
    if index is not None:
        rank[~end] = index.find(hashes[~end])
    row = np.repeat(np.arange(len(counts)), counts)
    return Tokens(hashes, rank, row, np.arange(total) - np.repeat(last - counts + 1, counts), end)


def _before(values: np.ndarray, t: Tokens, steps: int, start) -> np.ndarray:
    out = np.empty_like(values)
    out[steps:], out[:steps] = values[:-steps], start
    out[t.place < steps] = start
    return out


def _each(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[Words]:
    for batch in batches:
        for _, _, words in word_slices(batch.column(column)):
            yield words


def _rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def corpus_counts(docs: DataFrame, column: str = "text", flush: int = 2_000_000) -> DataFrame:
    """key (fingerprint as a signed long), n: counts of all tokens, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return _rows(keys.view(np.int64), np.bincount(place, weights=np.concatenate([n for _, n in held])))

        for words in _each(batches, 0):
            keys, n = np.unique(np.append(words.hashes(), np.full(len(words.counts), END)), return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > flush:
                yield merged()
                held, size = [], 0
        if held:
            yield merged()

    return docs.select(column).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words, most frequent first, and the corpus' totals."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    index: Seen = field(init=False)

    def __post_init__(self):
        self.index = Seen(max(4, len(self.hashes).bit_length() + 3))
        self.index.add(self.hashes)


def corpus_size(counts: DataFrame) -> tuple[int, int]:
    """All tokens and the distinct ones."""
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    return int(row["total"]), int(row["distinct"])


def vocabulary(counts: DataFrame, shape: Shape, total: int, distinct: int) -> Vocabulary:
    words = counts.where(F.col("key") != int(END.view(np.int64)))
    # the largest counts are found from a histogram of bounded size, so that no task sends a table of its own
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(64 * F.log2(F.col("n") / 4096)))
    sizes = words.groupBy(step.cast("long").alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).toPandas()
    fits = sizes["words"].cumsum() <= shape.table
    least = int(sizes.loc[fits, "least"].min()) if fits.any() else None
    top = words.where(F.col("n") >= least if least is not None else F.lit(False)).toPandas().sort_values(["n", "key"], ascending=[False, True])
    return Vocabulary(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total, distinct)


def _summed(frame: DataFrame, size: int) -> np.ndarray:
    """Summed counts by cell, for at most ``size`` cells."""
    found = frame.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[found["key"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return out


def neighbour_counts(docs: DataFrame, words: Vocabulary, shape: Shape, column: str = "text") -> np.ndarray:
    """For each word of the vocabulary, how often each of the most frequent words stands after it, and before it."""
    near = shape.neighbours
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index
        cells = np.zeros(shape.vocab * near * 2, np.int64)
        for found in _each(batches, 0):
            t = tokens(found, index)
            left = _before(t.rank, t, 1, -1)
            for word, other, side in ((left, t.rank, 0), (t.rank, left, 1)):
                at = np.flatnonzero((word >= 0) & (word < shape.vocab) & (other >= 0) & (other < near))
                cells += np.bincount((word[at] * 2 + side) * near + other[at], minlength=len(cells))
        some = np.flatnonzero(cells)
        yield _rows(some, cells[some])

    return _summed(docs.select(column).mapInArrow(run, "key long, n long"), shape.vocab * near * 2).reshape(shape.vocab, 2 * near)


def cluster(profile: np.ndarray, weight: np.ndarray, classes: int, seed: int = 5, rounds: int = 15) -> np.ndarray:
    """Classes of words by k-means on the square roots of their neighbours' shares."""
    points = np.sqrt((profile + 0.1) / (profile + 0.1).sum(axis=1, keepdims=True))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), classes, replace=False)] if len(points) >= classes else points
    label = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        label = (points @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            own = label == c
            if own.any():
                centre = (points[own] * weight[own, None]).sum(axis=0)
                centres[c] = centre / (np.linalg.norm(centre) or 1.0)
    return label


@dataclass
class Model:
    shape: Shape
    words: Vocabulary
    of: np.ndarray  # outcome of each word of the vocabulary
    weights: np.ndarray  # features x outcomes
    bias: np.ndarray  # of words in their class
    first: np.ndarray  # contexts x words: the class before
    skip: np.ndarray  # contexts x words: the class before that
    norm: np.ndarray  # outcomes x contexts x contexts
    ends: int = 0  # texts learnt from

    def outcome(self, t: Tokens) -> np.ndarray:
        known = (t.rank >= 0) & (t.rank < len(self.of))
        out = np.full(len(t.rank), self.shape.classes)
        out[known] = self.of[t.rank[known]]
        out[t.end] = self.shape.classes + 1
        return out

    def features(self, t: Tokens) -> np.ndarray:
        """Three hashed features of each token's history."""
        bits = np.uint64(64 - self.shape.bits)
        one, two = _before(t.hashes, t, 1, np.uint64(1)), _before(t.hashes, t, 2, np.uint64(2))
        size = 1 << self.shape.bits
        pair = mix(one * np.uint64(3) + mix(two + np.uint64(7))) >> np.uint64(64 - self.shape.bits - 1)
        return np.stack(((mix(one) >> bits).astype(np.int64), size + (mix(two + np.uint64(11)) >> bits).astype(np.int64), 2 * size + pair.astype(np.int64)), axis=1)

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        w = self.weights
        return w[rows[:, 0]] + w[rows[:, 1]] + w[rows[:, 2]] + w[-1]

    def log_prob(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each token, without log(count + 1) of words outside the table; and which those are."""
        out = np.empty(len(t.rank))
        outcome, rows = self.outcome(t), self.features(t)
        for a in range(0, len(out), 1 << 15):
            z = self.class_logits(rows[a : a + (1 << 15)])
            z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(z)), outcome[a : a + (1 << 15)]]
            out[a : a + (1 << 15)] = own - np.log(np.exp(z).sum(axis=1))
        c1 = _before(outcome, t, 1, self.shape.classes + 2)
        c2 = _before(outcome, t, 2, self.shape.classes + 2)
        word = np.flatnonzero(outcome < self.shape.classes)
        r = t.rank[word]
        out[word] += self.bias[r] + self.first[c1[word], r] + self.skip[c2[word], r] - self.norm[outcome[word], c1[word], c2[word]]
        rare = np.flatnonzero(outcome == self.shape.classes)
        others = self.words.total - int(self.words.counts[: len(self.of)].sum()) - self.ends
        kinds = self.words.distinct - len(self.of) - (self.ends > 0)
        out[rare] -= np.log(others + kinds + 1)
        held = rare[t.rank[rare] >= 0]
        out[held] += np.log(self.words.counts[t.rank[held]] + 1)
        tail = np.zeros(len(out), bool)
        tail[rare[t.rank[rare] < 0]] = True
        return out, tail


def _segment_sum(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key; short keys make the sort a radix sort."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(values[order], at, axis=0)


def _train_classes(docs: DataFrame, model: Model, column: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass: each task's gradient updates of the class weights, averaged; and the counts for the word level."""
    shape = model.shape
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_out, n_ctx, vocab = shape.outcomes, shape.contexts, len(model.of)
    base = shape.features
    cells = [n_ctx * vocab, n_ctx * vocab, n_out * n_ctx * n_ctx]
    names = [f"w{i}" for i in range(n_out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = m.weights.copy()
        seen = np.full(len(w), 1e-4)
        met = np.zeros(len(w), np.int64)
        sums = [np.zeros(size, np.int64) for size in cells]
        for words in _each(batches, 0):
            t = tokens(words, m.words.index)
            outcome, rows = m.outcome(t), m.features(t)
            c1, c2 = _before(outcome, t, 1, shape.classes + 2), _before(outcome, t, 2, shape.classes + 2)
            word = np.flatnonzero(outcome < shape.classes)
            sums[0] += np.bincount(c1[word] * vocab + t.rank[word], minlength=cells[0])
            sums[1] += np.bincount(c2[word] * vocab + t.rank[word], minlength=cells[1])
            sums[2] += np.bincount((outcome * n_ctx + c1) * n_ctx + c2, minlength=cells[2])
            met += np.bincount(rows.ravel(), minlength=len(met))
            met[-1] += len(rows)
            size = 1 << shape.bits
            starts = np.array([0, size, 2 * size])  # of the three features; keys within one sort faster
            short = (rows - starts).astype(np.uint16) if shape.bits < 16 else rows - starts
            for a in range(0, len(rows), shape.batch):
                r, y = rows[a : a + shape.batch], outcome[a : a + shape.batch]
                z = w[r[:, 0]] + w[r[:, 1]] + w[r[:, 2]] + w[-1]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(y)), y] -= 1
                for j in range(3):
                    key, g = _segment_sum(z, short[a : a + shape.batch, j])
                    key = key + starts[j]
                    seen[key] += (g * g).mean(axis=1)
                    w[key] -= (shape.rate / np.sqrt(seen[key]))[:, None].astype(np.float32) * g
                g = z.sum(axis=0)
                seen[-1] += (g * g).mean()
                w[-1] -= np.float32(shape.rate / np.sqrt(seen[-1])) * g
        at = np.flatnonzero(met)
        yield packed(at, met[at], w[at] * met[at, None].astype(float))
        flat = np.concatenate([*sums, np.zeros(-sum(cells) % n_out, np.int64)]).reshape(-1, n_out)
        at = np.flatnonzero(flat.any(axis=1))
        yield packed(base + at, np.zeros(len(at), np.int64), flat[at].astype(float))

    def packed(key: np.ndarray, n: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(n_out)]], ["key", "n", *names])

    schema = "key long, n long, " + ", ".join(f"{x} double" for x in names)
    found = docs.select(column).mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toPandas()
    key, n, values = found["key"].to_numpy(np.int64), found["n"].to_numpy(float), found[names].to_numpy(float)
    weights = np.zeros((base, n_out), np.float32)
    own = key < base
    weights[key[own]] = (values[own] / n[own, None]).astype(np.float32)
    flat = np.zeros((-(-sum(cells) // n_out), n_out))
    flat[key[~own] - base] = values[~own]
    flat = flat.ravel()[: sum(cells)]
    one, two, three = np.split(flat, np.cumsum(cells)[:-1])
    return weights, one.reshape(n_ctx, vocab), two.reshape(n_ctx, vocab), three.reshape(n_out, n_ctx, n_ctx)


def fit_class(one: np.ndarray, two: np.ndarray, n: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradient ascent on a class's words, from counts: observed minus expected, ridged. bias, first, skip and norm.

    ``one``, ``two``: contexts x words of the class; ``n``: how often each pair of contexts met the class.
    """
    count = one.sum(axis=0)
    seen_1, seen_2, seen_b = (np.full(x.shape, 1e-2) for x in (one, two, count))
    p_class = (count + 0.5) / (count + 0.5).sum()
    strong = 50.0
    start = (one + strong * p_class) / (one.sum(axis=1, keepdims=True) + strong)
    first, skip, bias = np.log(start) - np.log(p_class), np.zeros(two.shape), np.log(p_class)
    for _ in range(shape.fit_steps):
        z = bias + first[:, None, :] + skip[None, :, :]
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p *= (n / p.sum(axis=2))[:, :, None]
        for value, goal, have, seen, ridge in ((first, one, p.sum(axis=1), seen_1, 0.5), (skip, two, p.sum(axis=0), seen_2, 0.5), (bias, count, p.sum(axis=(0, 1)), seen_b, 0.0)):
            g = goal - have - ridge * value
            seen += g * g
            value += 0.3 * g / np.sqrt(seen)
    z = bias + first[:, None, :] + skip[None, :, :]
    top = z.max(axis=2)
    return bias, first, skip, top + np.log(np.exp(z - top[:, :, None]).sum(axis=2))


def _fit_words(spark: SparkSession, model: Model, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> None:
    """The word level: each class is fitted in a task of its own, which gets the counts of its words only."""
    shape = model.shape
    words = [np.flatnonzero(model.of == c) for c in range(shape.classes)]
    model.bias, model.first, model.skip = np.log(one.sum(axis=0) + 0.5), np.zeros_like(one), np.zeros_like(two)
    model.norm = np.zeros((shape.outcomes, shape.contexts, shape.contexts))
    rows = [(c, one[:, own].tobytes(), two[:, own].tobytes(), three[c].tobytes()) for c, own in enumerate(words) if len(own)]
    if not rows:
        return
    matrix = lambda code, width: np.frombuffer(code).reshape(-1, width) if width else np.frombuffer(code).reshape(shape.contexts, -1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                found = fit_class(matrix(r["one"], 0), matrix(r["two"], 0), matrix(r["three"], shape.contexts), shape)
                yield pa.RecordBatch.from_pydict({"class": pa.array([r["class"]], pa.int32()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("bias", "first", "skip", "norm"), found)}})

    counts = spark.createDataFrame(rows, "class int, one binary, two binary, three binary")
    for r in counts.mapInArrow(run, "class int, bias binary, first binary, skip binary, norm binary").collect():
        own = words[r["class"]]
        model.bias[own], model.norm[r["class"]] = np.frombuffer(r["bias"]), matrix(r["norm"], shape.contexts)
        model.first[:, own], model.skip[:, own] = matrix(r["first"], 0), matrix(r["skip"], 0)


def train(docs: DataFrame, counts: DataFrame, *, shape: Shape | None = None, column: str = "text") -> Model:
    """A model of the texts in ``column``; ``counts`` are their corpus_counts, from which its sizes follow if no ``shape`` is given."""
    total, distinct = corpus_size(counts)
    shape = shape or Shape.of_corpus(total, distinct)
    words = vocabulary(counts, shape, total, distinct)
    ends = counts.where(F.col("key") == int(END.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    vocab = min(shape.vocab, len(words.hashes))
    profile = neighbour_counts(docs, words, shape, column)[:vocab] if vocab else np.zeros((0, 2 * shape.neighbours))
    of = cluster(profile, words.counts[:vocab].astype(float), shape.classes) if vocab else np.zeros(0, np.int64)
    model = Model(shape, words, of, np.zeros((shape.features, shape.outcomes), np.float32), np.zeros(vocab), np.zeros((shape.contexts, vocab)), np.zeros((shape.contexts, vocab)), np.zeros((shape.outcomes, shape.contexts, shape.contexts)), int(ends))
    model.weights, one, two, three = _train_classes(docs, model, column)
    _fit_words(docs.sparkSession, model, one, two, three)
    return model


def score(docs: DataFrame, model: Model, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns ``keep``, n_tokens, n_known, base_score, score.

    base_score: add-one unigram log10 probability; score: the model's.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    own = [id_col, *keep]
    names = [*own, "n_tokens", "n_known", "base", "model", "n_tail", "tail", "times"]
    denominator = float(np.log10(model.words.total + model.words.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(m.words.counts + 1.0)
        end_log = float(np.log10(m.ends + 1.0))
        for batch in batches:
            for a, b, words in word_slices(batch.column(len(own))):
                t = tokens(words, m.words.index)
                prob, tail = m.log_prob(t)
                base = np.full(len(t.rank), 0.0)
                known = t.rank >= 0
                base[known] = logs[t.rank[known]]
                base[t.end] = end_log
                add = lambda x: np.bincount(t.row, weights=x, minlength=b - a)
                outside = np.flatnonzero((t.rank < 0) & ~t.end)
                order = outside[np.lexsort((t.hashes[outside], t.row[outside]))]
                row, h = t.row[order], t.hashes[order]
                at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(row) else np.zeros(0, np.int64)
                times = np.diff(at, append=len(row))
                offsets = pa.array(np.searchsorted(row[at], np.arange(b - a + 1)).astype(np.int32))
                n = add(np.ones(len(t.rank))).astype(np.int64)
                inside = add((known | (t.end & (m.ends > 0))).astype(float)).astype(np.int64)
                columns = [n, inside, add(base), add(prob) / np.log(10), add(tail.astype(float)).astype(np.int64)]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[at].view(np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*[x.slice(a, b - a) for x in batch.columns[: len(own)]], *[pa.array(x) for x in columns], *lists], names)

    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", n_tokens long, n_known long, base double, model double, n_tail long, tail array<long>, times array<long>"
    rows = checkpointed(docs.select(*own, F.col(text_col).cast("string").alias(text_col) if text_col not in own else F.col(text_col)).mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()))
    each = rows.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("key"), F.col("x.times").alias("k"))
    met = each.join(counts, "key", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("logs"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more"),
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.join(met, "rid", "left").select(
        *own,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + logs - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def lm_scores(docs: DataFrame, *, held_out: Column, id_col: str = "doc_id", text_col: str = "text", shape: Shape | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows outside ``held_out`` (null: learns). Tokens
    are the words between space and 09-0D, A-Z in lower case, and one end per
    text; a null text is empty. Repeated rows count and score like any other,
    other columns are ignored; without training rows every word is unknown and
    an empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    learn = plain.where(~F.col("held_out"))
    counts = checkpointed(corpus_counts(learn))
    model = train(learn, counts, shape=shape)
    scored = score(plain, model, counts, keep=("held_out",))
    return scored.withColumn("train_tokens", F.lit(model.words.total).cast("long"))
