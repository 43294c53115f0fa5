"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each partition cuts its rows into chunks, and sends the chunk's distinct
   fingerprints (48 bits of SHA-256) to the owners of their ranges, sorted and
   Golomb-coded: a few bits more than the entropy of the gaps.
2. An owner merges the chunks' lists and answers each with a bitmap: which of
   its fingerprints another chunk sent too.
3. A row is a suspect if its fingerprint is marked, or repeats in its chunk.
   Suspects' fingerprints make a filter of bounded size, which every scan task
   gets: of the texts only those that pass it are shuffled, and grouped by
   their bytes. Whatever passes by chance is told apart by its whole hash.

A fingerprint that a third of all rows share is sent once by each chunk, and
its texts meet in a group-by that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlab.llm.session import checkpointed
from barlab.llm.suspects import passing, suspect_filter

SPACES = r"[\x20\x09-\x0D]+"
FINGERPRINT_BITS = 48
_ROW_BITS = 33  # of monotonically_increasing_id: the row within a partition


def golomb_encode(values: np.ndarray, universe: int) -> tuple[bytes, int]:
    """Sorted distinct integers below ``universe`` as Rice-coded gaps, and the code's parameter.

    Quotients (unary) and remainders lie in two runs, so that decoding needs no loop.
    """
    n = len(values)
    if not n:
        return b"", 0
    k = max(0, int(np.floor(np.log2(max(1.0, 0.69 * universe / n)))))
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    quotients = gaps >> k
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.int64)
    rest = ((gaps[:, None] >> shifts) & 1).astype(np.uint8).ravel()
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes(), k


def golomb_decode(code: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    tail = (n * k + 7) // 8
    raw = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.int64)
    rest = np.unpackbits(raw[len(raw) - tail :])[: n * k].reshape(n, k).astype(np.int64)
    return np.cumsum((quotients << k) + (rest << shifts).sum(axis=1) + 1) - 1


def _owner_ranges(fingerprints: np.ndarray, owners: int) -> np.ndarray:
    """Owners split the fingerprints into equal ranges."""
    width = -(-(1 << FINGERPRINT_BITS) // owners)
    return fingerprints // width


def _blocks(part: int, chunk: int, fingerprints: np.ndarray, owners: int) -> dict:
    distinct = np.unique(fingerprints)
    owner = _owner_ranges(distinct, owners)
    width = -(-(1 << FINGERPRINT_BITS) // owners)
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    rows: dict = {"owner": [], "part": [], "chunk": [], "n": [], "k": [], "code": []}
    for a, b in zip(at, [*at[1:], len(distinct)], strict=True):
        code, k = golomb_encode(distinct[a:b] - int(owner[a]) * width, width)
        for name, value in zip(rows, (int(owner[a]), part, chunk, int(b - a), k, code), strict=True):
            rows[name].append(value)
    return rows


_BLOCK = "owner long, part long, chunk long, n long, k int, code binary"
_BLOCK_ARROW = pa.schema([("owner", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("code", pa.binary())])


def _sender(owners: int, chunk_rows: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            found = batch.column("fp").to_numpy(zero_copy_only=False)
            part = rid >> _ROW_BITS
            chunk = (rid & ((1 << _ROW_BITS) - 1)) // chunk_rows
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(chunk) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rid)], strict=True):
                if a == b:
                    continue
                now = (int(part[a]), int(chunk[a]))
                if key is not None and now != key:
                    yield pa.RecordBatch.from_pydict(_blocks(*key, np.concatenate(held), owners), _BLOCK_ARROW)
                    held = []
                key = now
                held.append(found[a:b])
        if key is not None:
            yield pa.RecordBatch.from_pydict(_blocks(*key, np.concatenate(held), owners), _BLOCK_ARROW)

    return send


def _answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: which fingerprints of a chunk another chunk sent too."""
    lists = [golomb_decode(c, n, k) for c, n, k in zip(blocks["code"], blocks["n"], blocks["k"], strict=True)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    bits = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"owner": blocks["owner"], "part": blocks["part"], "chunk": blocks["chunk"], "bits": bits})


def _marker(owners: int):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy()
        distinct, place, counts = np.unique(fp, return_inverse=True, return_counts=True)
        bad = counts > 1
        owner = _owner_ranges(distinct, owners)
        for who, bits in zip(answers["owner"], answers["bits"], strict=True):
            own = slice(*np.searchsorted(owner, [who, who + 1]))
            bad[own] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: own.stop - own.start].astype(bool)
        return rows.loc[bad[place], ["rid", "doc_id", "sha"]]

    return mark


def _first_of(doc_id: str, rid: str):
    """Order of rows: by document id, nulls last, then as stored."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(rid).alias("rid"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 200_000, owner_rows: int = 2_000_000, salts: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of space and 09-0D
    became one space. A null text counts as empty. Of equal texts the row with
    the smallest id stays; a null id comes last, and of rows with the same id
    and text the first one stays, so that each group keeps one row. Extra
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")
    source = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    sha = F.sha2(F.col("norm"), 256)
    fp = F.conv(F.substring(F.hex("sha"), 1, FINGERPRINT_BITS // 4), 16, 10).cast("long").alias("fp")
    keyed = checkpointed(source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.unhex(sha).alias("sha")).select("*", fp))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(shuffle, -(-keyed.count() // owner_rows))
    blocks = keyed.select("rid", "fp").mapInArrow(_sender(owners, chunk_rows), _BLOCK)
    answers = blocks.groupBy("owner").applyInPandas(_answer, "owner long, part long, chunk long, bits binary")
    parts = keyed.withColumns({"part": F.shiftright("rid", _ROW_BITS), "chunk": F.floor(F.col("rid").bitwiseAND((1 << _ROW_BITS) - 1) / chunk_rows)})
    types = dict(keyed.dtypes)
    suspects = checkpointed(
        parts.groupBy("part", "chunk").cogroup(answers.groupBy("part", "chunk")).applyInPandas(_marker(owners), f"rid long, doc_id {types['doc_id']}, sha binary")
    )
    # byte verification: a group of a fingerprint holds one text only
    found, words = suspect_filter(suspects.select(fp))
    texts = passing(source.select(F.unhex(sha).alias("sha"), "norm").select("*", fp), checkpointed(found), words)
    verified = texts.groupBy("sha", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.count(F.lit(1)).alias("variants"))
    groups = (
        suspects.groupBy("sha")
        .agg(F.min(_first_of("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .join(verified, "sha")
        .select("sha", "group_size", F.when(F.col("variants") == 1, F.col("first")).otherwise(F.raise_error(F.lit("different texts under one SHA-256"))).alias("first"))
        .select("sha", "group_size", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = keyed.withColumn("salt", F.pmod(F.col("rid"), F.lit(salts)).cast("int"))
    return salted.join(groups, ["sha", "salt"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
