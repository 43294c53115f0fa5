"""Near duplicates by SetSketch registers, verified on full sets.

1. A document's set of word shingles is hashed; equal sets (by count and a
   128-bit fingerprint) become one node at once, so exact copies cost nothing
   further.
2. A node has ``bands`` x ``rows`` SetSketch registers: for each of as many
   hash functions, the set's smallest exponential value on a scale of powers
   of ``base``, truncated to integers. Registers of a union are the maxima.
   Nodes that agree on all registers of a band share a bucket.
3. First round: every node of a bucket is paired with the bucket's smallest.
   Pairs pass on if their sizes allow the similarity and if the likelihood of
   it, from how many registers are above, below and equal, peaks near or over
   the threshold; then the full sets decide. Linked nodes form components.
4. Second round, only for buckets that still hold several components: all
   pairs of nodes in different components, block by block inside tasks, each
   pair in the first band that it shares. Those that pass the same two tests
   are verified in their block, to which each node's full set is sent once. No
   pair inside a component is tested, no pair becomes a row unless it links,
   and none is left out for the size of its bucket. The nodes of a bucket's
   largest component meet the others only: a bucket of n nodes of which r lie
   outside of it sends about (2 n r + r^2) / chunk rows to blocks. Buckets of
   more than ``wide`` nodes are first cut finer: linked sets share one of the
   first shingles of both, frequent ones last, of the smaller set one of about
   half as many; such a shingle takes the bucket's place, and only pairs with
   the smaller set in its shorter prefix meet. Texts of one template that are
   not near enough have as many shingles of their own, so they do not meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from barlab.llm.components import components
from barlab.llm.suspects import passing, suspect_filter
from barlab.llm.kernels import Words, mix, ranges, word_slices
from barlab.llm.session import checkpointed

_BAND = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Sketch:
    """What decides a link, and the registers. ``slack``: standard errors by which an estimate may fall short of the threshold."""

    width: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 6
    base: float = 1.02
    rate: float = 20.0
    slack: float = 4.5
    seed: int = 17

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> float:
        j = self.percent / 100
        return j - self.slack * float(np.sqrt(j * (1 - j) / self.size))

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 1 << 32, self.size, dtype=np.uint32), rng.integers(0, 1 << 32, self.size, dtype=np.uint32) | np.uint32(1)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and their number per row.

    A row with fewer than ``width`` words has its whole sequence as one
    shingle, a row without words none.
    """
    h, counts, first = words.hashes(), words.counts, words.first
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + first[rows]
    size = np.minimum(counts, width)[rows]
    value = np.zeros(len(rows), np.uint64)
    for k in range(width):
        inside = size > k
        step = mix(h[np.minimum(at + k, len(h) - 1)] + np.uint64(k + 1)) if len(h) else value
        value = np.where(inside, mix(value * np.uint64(3) + step), value)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(rows[order].astype(np.uint16) if len(counts) < 1 << 16 else rows[order], kind="stable")]
    value, rows = value[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[new], np.bincount(rows[new], minlength=len(counts)).astype(np.int64)


def registers(values: np.ndarray, counts: np.ndarray, sketch: Sketch) -> np.ndarray:
    """SetSketch registers (uint16) of each set; rows of empty sets are zero."""
    out = np.zeros((len(counts), sketch.size), np.uint16)
    some = np.flatnonzero(counts > 0)
    if not len(some):
        return out
    low = (values >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(counts) - counts)[some]
    least = np.empty((sketch.size, len(some)), np.uint32)
    add, times = sketch.functions()
    for j in range(sketch.size):
        least[j] = np.minimum.reduceat((low ^ add[j]) * times[j], starts)
    x = -np.log1p(-(least.T.astype(float) + 0.5) / 2.0**32) / sketch.rate
    out[some] = np.clip(np.floor(1 - np.log(x) / np.log(sketch.base)), 0, 65535).astype(np.uint16)
    return out


def log_likelihood(j, above: np.ndarray, below: np.ndarray, u: np.ndarray, v: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Of a similarity j, for sets with shares u and v of their sizes' sum."""
    b = sketch.base
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / np.log(b)
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    p_above, p_below = p(u - v * j), p(v - u * j)
    return above * safe(p_above) + below * safe(p_below) + (sketch.size - above - below) * safe(1 - p_above - p_below)


def estimate(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, from how many of one's registers lie above and below the other's, and the set sizes n and m."""
    u, v = n / (n + m), m / (n + m)
    likelihood = lambda j: log_likelihood(j, above, below, u, v, sketch)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(24):  # golden section; the likelihood has one peak
        x, y = high - g * (high - low), low + g * (high - low)
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Pairs (rows of registers) that sizes and likelihood leave open: its one peak, the estimate, lies at ``sketch.least`` or above if it still rises there."""
    fits = 100 * np.minimum(n, m) >= sketch.percent * np.maximum(n, m)
    out = np.zeros(len(n), bool)
    at = np.flatnonzero(fits)
    if len(at):
        above, below = (a[at] > b[at]).sum(axis=1), (a[at] < b[at]).sum(axis=1)
        n, m = n[at].astype(float), m[at].astype(float)
        u, v = n / (n + m), m / (n + m)
        at_least = lambda j: log_likelihood(j, above, below, u, v, sketch)
        out[at] = at_least(sketch.least + 1e-4) >= at_least(sketch.least)
    return out


def _fingerprints(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    out = []
    for salt in (0x51ED270B, 0xA24BAED4):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)))
        out.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return out[0], out[1]


def _sketched(docs: DataFrame, sketch: Sketch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_slices(batch.column(1)):
                values, counts = shingle_sets(words, sketch.width)
                f1, f2 = _fingerprints(values, counts)
                found = registers(values, counts, sketch)
                packed = pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(counts), pa.array(f1), pa.array(f2), packed], ["doc_id", "text_hash", "n", "f1", "f2", "registers"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n long, f1 long, f2 long, registers binary")


def _sets(docs: DataFrame, sketch: Sketch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_slices(batch.column(0)):
                values, counts = shingle_sets(words, sketch.width)
                f1, f2 = _fingerprints(values, counts)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(counts), pa.array(f1), pa.array(f2), lists], ["n", "f1", "f2", "shingles"])

    return docs.select("text").mapInArrow(run, "n long, f1 long, f2 long, shingles array<long>")


def _matrix(column: pa.Array, sketch: Sketch) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), sketch.size)


def _buckets(nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """node and bucket (hash of a band and its registers), for buckets of two nodes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = _matrix(batch.column(1), sketch).astype(np.uint64)
            keys = np.empty((len(regs), sketch.bands), np.uint64)
            for band in range(sketch.bands):
                key = np.full(len(regs), band + 1, np.uint64) * _BAND
                for k in range(band * sketch.rows, (band + 1) * sketch.rows):
                    key = mix(key * np.uint64(31) + regs[:, k])
                keys[:, band] = key
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sketch.bands)
            band = np.tile(np.arange(sketch.bands, dtype=np.int32), len(regs))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(band), pa.array(keys.ravel().view(np.int64))], ["node", "band", "bucket"])

    rows = nodes.select("node", "registers").mapInArrow(run, "node long, band int, bucket long")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot")).where("members > 1")
    return rows.join(shared, "bucket")


def _open_pairs(pairs: DataFrame, nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """Of pairs a, b those that sizes and likelihood leave open."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n, m = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                keep = may_link(_matrix(part.column(4), sketch), _matrix(part.column(5), sketch), n, m, sketch)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    ready = pairs.join(side("a"), "a").where("100 * n_a > 0").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {sketch.percent} * greatest(n_a, n_b)")
    return ready.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, sketch: Sketch) -> DataFrame:
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    ready = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    counted = ready.select("a", "b", both.alias("both"), (F.size("s_a") + F.size("s_b")).cast("long").alias("total"))
    return counted.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * sketch.percent).select("a", "b")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys (whole numbers), of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        found = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        cuts = np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True):
            if a == b:
                continue
            now = tuple(found[a])
            if key is not None and now != key:
                yield pa.concat_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


_BLOCK = ["bucket", "x", "y"]
#: Nodes from which on a shingle's number of nodes counts in the order of shingles.
FREQUENT = 16


def _open_blocks(members: DataFrame, sketch: Sketch, chunk: int, parts: int) -> DataFrame:
    """Open pairs of nodes in different components of a bucket, one row for each block that has some.

    The ``most`` nodes that are ``inside`` and the ``rest`` are cut into chunks
    of about ``chunk`` nodes each, and every two chunks meet in a block of
    their own, but for two of the inside ones. A pair comes from the first
    band that it shares, or (band -1) if the smaller set has the bucket's
    shingle in the shorter prefix. A row holds the nodes that occur in pairs,
    their components, and the pairs as places among them.
    """
    chunks = lambda n: F.ceil(F.col(n) / chunk).cast("int")
    inside = F.col("inside")
    hashed = F.xxhash64("node")
    mine = F.when(inside, F.pmod(hashed, chunks("most"))).otherwise(chunks("most") + F.pmod(hashed, chunks("rest"))).cast("int")
    first = F.when(inside, chunks("most")).otherwise(F.lit(0))
    spread = members.withColumns({"mine": mine, "other": F.explode(F.sequence(first, chunks("most") + chunks("rest") - 1))})
    blocks = spread.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "band", "node", "label", "n", "inside", "registers")

    def block(rows: pa.RecordBatch) -> tuple | None:
        get = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
        node, label, n, mine = get("node"), get("label"), get("n"), get("mine")
        x, y, band = (int(get(c)[0]) for c in ("x", "y", "band"))
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        some = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= sketch.percent * np.maximum(n[i], n[j]))
        if x == y:
            some &= node[i] < node[j]
        if band < 0:
            early = ~get("inside")
            some &= (early[i] & (n[i] <= n[j])) | (early[j] & (n[j] <= n[i]))
        i, j = i[some], j[some]
        if not len(i):
            return None
        regs = _matrix(rows.column("registers"), sketch)
        found_i, found_j = [], []
        for a in range(0, len(i), 8192):
            p, q = i[a : a + 8192], j[a : a + 8192]
            if band >= 0:
                same = (regs[p] == regs[q]).reshape(len(p), sketch.bands, sketch.rows).all(axis=2)
                first = same.argmax(axis=1) == band
                p, q = p[first], q[first]
            keep = may_link(regs[p], regs[q], n[p], n[q], sketch)
            found_i.append(p[keep])
            found_j.append(q[keep])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        if not len(i):
            return None
        used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
        return int(get("bucket")[0]), x, y, node[used], label[used], place[: len(i)], place[len(i) :]

    names = [*_BLOCK, "nodes", "labels", "i", "j"]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, _BLOCK):
            if (found := block(rows)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, types, strict=True)], names)

    sorted_blocks = blocks.repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK)
    return sorted_blocks.mapInArrow(run, "bucket long, x int, y int, nodes array<long>, labels array<long>, i array<int>, j array<int>")


def _several(tagged: DataFrame) -> DataFrame:
    """Buckets that hold several components: their largest component, its nodes and the others."""
    per_label = tagged.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    counted = per_label.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("x"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels"))
    return counted.where("labels > 1").select("bucket", F.col("x.label").alias("largest"), F.col("x.c").alias("most"), (F.col("all") - F.col("x.c")).alias("rest"))


def _by_prefix(members: DataFrame, nodes: DataFrame, sets: DataFrame, sketch: Sketch, frequent: int, salts: int) -> DataFrame:
    """node, label, band (-1), bucket and inside: shingles of the node's prefixes, with most and rest of their buckets.

    Of two sets that link, with sizes n <= m, the shared shingles are at least
    p (n + m) / (1 + p) of a similarity p, so 2 p n / (1 + p) and p m as well.
    So among the first n - 2 p n / (1 + p) + 1 shingles of the smaller one and
    the first m - p m + 1 of the larger one, in an order of all shingles, there
    is a common one. The order puts shingles of ``frequent`` nodes or more last,
    by their number of nodes. ``inside``: a shingle of the longer prefix only;
    two of these need not meet, and a bucket of none but these goes.
    """
    each = members.join(sets, "node").select("node", "label", F.explode("shingles").alias("bucket"))
    often = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= frequent)
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ranked = each.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(often, ["bucket", "salt"], "left").join(nodes.select("node", "n"), "node")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(0)), "bucket"))
    p = sketch.percent
    after = lambda share, of: F.col("n") - F.expr(f"(n * {share} + {of - 1}) div {of}") + 1
    prefix = ranked.withColumn("place", place).where(F.col("place") <= after(p, 100))
    cut = checkpointed(prefix.select("node", "label", F.lit(-1).alias("band"), "bucket", (F.col("place") > after(2 * p, 100 + p)).alias("inside")))
    met = cut.groupBy("bucket").agg(F.count_if("inside").alias("most"), F.count_if(~F.col("inside")).alias("rest"), (F.min("label") < F.max("label")).alias("several"))
    return cut.join(met.where("several AND rest > 0").drop("several"), "bucket")


def _links_in_blocks(blocks: DataFrame, sets: DataFrame, sketch: Sketch, parts: int) -> DataFrame:
    """Verified pairs of the blocks, as many as join their components: each node's full set is sent to its blocks once."""
    head = blocks.select(*_BLOCK, F.lit(-1).alias("place"), "nodes", "labels", "i", "j", F.lit(None).cast("array<bigint>").alias("shingles"))
    each = blocks.select(*_BLOCK, F.posexplode("nodes").alias("place", "node")).join(sets, "node")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("nodes", "array<bigint>"), ("labels", "array<bigint>"), ("i", "array<int>"), ("j", "array<int>"))]
    rows = head.unionByName(each.select(*_BLOCK, "place", *none, "shingles"))

    def links(rows: pa.RecordBatch) -> tuple[list[int], list[int]]:
        nodes, labels, i, j = (np.array(rows.column(c)[0].as_py()) for c in ("nodes", "labels", "i", "j"))
        lists = rows.column("shingles").slice(1)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.array(pa.compute.list_value_length(lists).to_pylist(), np.int64)
        start = np.cumsum(size) - size
        _, dense = np.unique(values, return_inverse=True)
        flag = np.zeros(int(dense.max()) + 1, bool)
        root = {int(x): int(x) for x in labels}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out_a, out_b = [], []
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        at = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(at, [*at[1:], len(i)], strict=True):
            one, others = i[a], j[a:b]
            own = dense[start[one] : start[one] + size[one]]
            flag[own] = True
            shared = np.add.reduceat(flag[dense[ranges(start[others], size[others])]], np.cumsum(size[others]) - size[others], dtype=np.int64)
            flag[own] = False
            for k in others[100 * shared >= sketch.percent * (size[one] + size[others] - shared)]:
                p, q = find(int(labels[one])), find(int(labels[k]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out_a.append(int(nodes[one]))
                    out_b.append(int(nodes[k]))
        return out_a, out_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, _BLOCK):
            a, b = links(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK, "place").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = Sketch(), chunk: int = 256, wide: int = 4096, salts: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text), first.

    Documents link when 100 * shared shingles >= percent * all shingles of
    both; a component is what links reach, named by its smallest id, which is
    kept. Words are split at space and 09-0D, A-Z in lower case. A document
    without words, or with a null text, has an empty set, links with nothing
    and is kept. Rows with the same id and text share their component; a null
    id counts only where a component has no other, and then stays null and is
    kept. ``first`` marks exactly one row of each component, also where ids
    repeat or are null. Other columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(_sketched(plain, sketch).withColumn("rid", F.monotonically_increasing_id()))
    filled = rows.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = filled.groupBy("f1", "f2", "n").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")).select("f1", "f2", "n", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("node"))
    groups = checkpointed(groups)
    nodes = checkpointed(filled.select(F.col("rid").alias("node"), "n", "registers").join(groups.select("node"), "node", "left_semi"))
    buckets = checkpointed(_buckets(nodes, sketch))
    stars = buckets.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = checkpointed(_open_pairs(stars, nodes, sketch))
    # full sets of all nodes that share a bucket, from the text of one row each
    wanted = groups.join(buckets.select("node").distinct(), "node", "left_semi").select("f1", "f2", "n", "node")
    found, words = suspect_filter(rows.select("doc_id", "text_hash", F.col("rid").alias("node")).join(wanted, "node", "left_semi").select(F.xxhash64("doc_id", "text_hash").alias("fp")))
    texts = passing(plain.withColumn("fp", F.xxhash64("doc_id", F.xxhash64("text"))), checkpointed(found), words)
    sets = _sets(texts, sketch).join(wanted.select("f1", "f2", "n", "node"), ["f1", "f2", "n"]).dropDuplicates(["node"]).select("node", "shingles")
    sets = checkpointed(sets)
    links = checkpointed(_verified(near, sets, sketch))
    labels = components(links)
    tagged = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked_in(where: DataFrame) -> DataFrame:
        blocks = _open_blocks(where.join(nodes, "node"), sketch, chunk, parts)
        return _links_in_blocks(checkpointed(blocks), sets, sketch, parts)

    several = checkpointed(_several(tagged))
    broad = F.col("most") + F.col("rest") > wide
    more = linked_in(tagged.join(several.where(~broad), "bucket").withColumn("inside", F.col("label") == F.col("largest")))
    if not several.where(broad).isEmpty():
        members = tagged.join(several.where(broad).select("bucket"), "bucket", "left_semi").select("node", "label").distinct()
        more = more.union(linked_in(_by_prefix(members, nodes, sets, sketch, FREQUENT, salts)))
    labels = components(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    named = labels.join(groups.select("node", "doc_id"), "node").groupBy("label").agg(least.alias("least")).select("label", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("front"))
    # a component may hold a large share of all nodes: each of its salts meets in a task of its own
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int").alias("salt")
    spread = named.select("label", "component_id", "front", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    linked = labels.select("node", "label", salt("node")).join(spread, ["label", "salt"]).select("node", "component_id", "front")
    where = (
        groups.join(linked, "node", "left")
        .where(F.col("front").isNotNull() | (F.col("copies") > 1))
        .select("f1", "f2", "n", F.when(F.col("front").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("front", "node").alias("front"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = rows.select("doc_id", "text_hash", "n", "f1", "f2", "rid", F.pmod("rid", F.lit(salts)).cast("int").alias("salt"))
    out = salted.join(where, ["f1", "f2", "n", "salt"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash",
        F.coalesce(F.col("rid") == F.col("front"), F.lit(True)).alias("first"),
    )


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT doc_id, doc_id AS z FROM documents
  UNION
  SELECT r.doc_id, u.z FROM r JOIN (SELECT x AS y, y AS z FROM e UNION ALL SELECT y, x FROM e) u ON u.y = r.z
), m AS (
  SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
