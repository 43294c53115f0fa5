"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. A round fills one window: it adds to every
queue's deficit its share of the window, and a queue is served a quantum when
its deficit reaches one: its share of a window, but ``least`` tokens at least,
so that pieces stay long, and a window at most. What a queue is owed when a
window is full is carried into the next one. A queue that runs dry leaves its
share to the others.

Where a quantum is served follows from the queue alone: with weight w, the one
from token x on, of size s, is served at time (x + u s) / w, with a phase u
between 0 and 1 for each queue, so that queues of less than a quantum do not
all come together. So at time t every queue has had w t tokens within a
quantum, whatever partitions its documents lie in. Pieces in the order of these
times, one after the other, are the windows. That order is never sorted in one
task: times are cut into about as many equal ranges as each then holds pieces,
the ranges' tokens are added up, and pieces are placed within their range. No
task and no driver holds a table of the sources.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from barlab.llm.bpe import word_bpe
from barlab.llm.kernels import slices, text_buffers
from barlab.llm.session import checkpointed

END_ID = 1
_PHASE_BITS = 30


def _tokens(docs: DataFrame, tokenizer: str, source_cols: list[str]) -> DataFrame:
    """Ids of each document, and its place among the tokens of its queue within the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = word_bpe(tokenizer)
        part = TaskContext.get().partitionId()
        so_far: dict[str, int] = {}
        for batch in batches:
            _, offsets = text_buffers(batch.column(2))
            for a, b in slices(offsets):
                queue = batch.column(1).slice(a, b - a).to_pylist()
                ids = [np.append(x, END_ID).astype("<u4") for x in machine.encode(batch.column(2).slice(a, b - a))]
                local = []
                for q, x in zip(queue, ids, strict=True):
                    local.append(so_far.get(q, 0))
                    so_far[q] = local[-1] + len(x)
                wide = max((int(x.max()) for x in ids), default=0) >= 1 << 16
                packed = [(x if wide else x.astype("<u2")).tobytes() for x in ids]
                size = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(queue, pa.string()), pa.array([part] * (b - a), pa.int64()), pa.array(local, pa.int64()), size, pa.array(packed, pa.binary())],
                    ["doc_id", "queue", "part", "local", "n", "ids"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", *source_cols, "text").mapInArrow(run, f"doc_id {kind}, queue string, part long, local long, n long, ids binary")


def _weight(weights: dict[str, float] | None) -> Column:
    """A queue's weight: its tokens, or what is listed, the smallest listed one for others."""
    if not weights:
        return F.col("total").cast("double")
    listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
    return F.coalesce(F.try_element_at(listed, F.col("queue")), F.lit(float(min(weights.values()))))


def pack(docs: DataFrame, *, tokenizer: str | None = None, length: int = 2048, weights: dict[str, float] | None = None, least: int = 32, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_rows: int = 500_000) -> DataFrame:
    """Pieces of documents in windows of ``length`` tokens: doc_id, queue, start, length, ids (binary, little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    Only the last window is short. ``weights``: target proportion of tokens by
    source, natural proportions where none are given (then every window holds
    the corpus' mixture, each source within about a quantum of its share); a
    source that is not listed gets the smallest listed weight. A document is
    cut where a quantum (of ``least`` tokens at least) or a window ends. Each
    source is a queue, at any number of them. A null text is a document of the
    end id alone, a null source a queue of its own; null and repeated ids are
    documents like any other; an empty table gives no pieces.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), queue.alias("queue"), F.col(text_col).cast("string").alias("text"))
    stored = checkpointed(_tokens(plain, tokenizer, ["queue"]))
    parts = stored.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("queue")
    ahead = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    phase = (F.xxhash64("queue").bitwiseAND((1 << _PHASE_BITS) - 1) + 0.5) / float(1 << _PHASE_BITS)
    bases = parts.select("queue", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long").alias("base"), F.sum("n").over(own).alias("total"))
    bases = checkpointed(bases.withColumns({"weight": _weight(weights), "phase": phase}))
    sums = bases.where("base = 0").groupBy("queue").agg(F.first("weight").alias("w"), F.first("total").alias("n")).agg(F.sum("w").alias("weights"), F.max(F.col("n") / F.col("w")).alias("end"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("queues")).first()
    if not sums["queues"]:
        return _with_bytes(stored.select("doc_id", "queue", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "n", "sequence_id", "offset")], "ids").where(F.lit(False)))
    quantum = F.greatest(F.lit(least), F.least(F.lit(length), F.round(F.lit(float(length)) * F.col("weight") / sums["weights"]))).cast("long")
    small = bases.withColumn("quantum", quantum)
    if bases.count() <= broadcast_rows:
        small = F.broadcast(small)
    placed = stored.join(small, ["queue", "part"]).withColumn("at", F.col("base") + F.col("local"))

    # a document's pieces: what it has of each quantum of its queue
    visits = F.sequence(F.expr("at div quantum"), F.expr("(at + n - 1) div quantum"))
    cut = placed.withColumn("visit", F.explode(visits)).withColumns({"from": F.greatest("at", F.col("visit") * F.col("quantum")), "to": F.least(F.col("at") + F.col("n"), (F.col("visit") + 1) * F.col("quantum"))})
    size = F.least(F.col("quantum"), F.col("total") - F.col("visit") * F.col("quantum"))
    time = (F.col("visit") * F.col("quantum") + F.col("phase") * size) / F.col("weight")
    some = F.expr("substring(ids, cast((`from` - at) * (length(ids) div n) + 1 as int), cast((`to` - `from`) * (length(ids) div n) as int))")
    ranges = max(1, round((stored.count() + sums["tokens"] / max(least, length // sums["queues"])) ** 0.5))
    timed = cut.select("doc_id", "queue", "n", (F.col("from") - F.col("at")).alias("start"), (F.col("to") - F.col("from")).alias("length"), "from", time.alias("time"), some.alias("ids"))
    timed = timed.withColumn("range", F.least(F.floor(F.col("time") / sums["end"] * ranges), F.lit(ranges - 1)))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = timed.groupBy("range").agg(F.sum("length").alias("tokens")).select("range", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"))
    line = Window.partitionBy("range").orderBy("time", "queue", "from").rowsBetween(Window.unboundedPreceding, -1)
    ordered = timed.withColumn("within", F.coalesce(F.sum("length").over(line), F.lit(0))).join(before, "range").withColumn("place", F.col("before") + F.col("within"))

    # and of these, what lies in each window
    spans = F.sequence(F.expr(f"place div {length}"), F.expr(f"(place + length - 1) div {length}"))
    window = ordered.withColumn("sequence_id", F.explode(spans))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * length)
    end = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * length)
    pieces = window.withColumns({"begin": begin, "end": end})
    bytes_ = F.expr("substring(ids, cast((begin - place) * (length(ids) div length) + 1 as int), cast((`end` - begin) * (length(ids) div length) as int))")
    return _with_bytes(pieces.select("doc_id", "queue", (F.col("start") + F.col("begin") - F.col("place")).alias("start"), (F.col("end") - F.col("begin")).alias("length"), "n", "sequence_id", (F.col("begin") - F.col("sequence_id") * length).alias("offset"), bytes_.alias("ids")))


def _with_bytes(pieces: DataFrame) -> DataFrame:
    """Pieces with their ids in 32 bits each, and the checksum of these bytes."""
    kind = dict(pieces.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, queue, start, size, n, window, offset, packed = batch.columns
            wide = [np.frombuffer(x.as_buffer(), "<u2" if x.as_buffer().size == 2 * k else "<u4").astype("<u4").tobytes() for x, k in zip(packed, size.to_pylist(), strict=True)]
            columns = [doc, queue, start, size, pa.array(wide, pa.binary()), pa.array([zlib.crc32(x) for x in wide], pa.int64()), n, window, offset]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "queue", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(run, f"doc_id {kind}, queue string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
