"""Rows that may be among chosen ones, picked at the scan by a filter of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_WORD_BITS = 6


def _filter_places(fp, words: int) -> tuple:
    """Word of a filter, and the two bits of it, that a fingerprint sets."""
    mixed = F.xxhash64(fp)
    bit = lambda at: F.expr(f"shiftleft(1L, cast(shiftright(__mixed, {at}) & {(1 << _WORD_BITS) - 1} as int))")
    word = F.coalesce(F.pmod(F.shiftrightunsigned("__mixed", 2 * _WORD_BITS), F.lit(words)), F.lit(0))  # never null: else a join would look for nulls first, at the scan, by hashing every text once more
    return mixed.alias("__mixed"), word.alias("word"), bit(0).bitwiseOR(bit(_WORD_BITS)).alias("bits")


def suspect_filter(fingerprints: DataFrame, most_words: int = 1 << 21) -> tuple[DataFrame, int]:
    """word and bits (long) of a Bloom filter with two bits for each value of ``fp``, and its number of words.

    About 32 bits a value let one in 250 of the others pass. From
    ``most_words`` (16 MB of bits) on it does not grow, so it can be sent to
    every task; then more pass by chance, and nothing is missed.
    """
    fp = fingerprints.select("fp").distinct()
    words = max(1, min(most_words, fp.count() // 2))
    mixed, word, bits = _filter_places(F.col("fp"), words)
    return fp.select(mixed).select(word, bits).groupBy("word").agg(F.bit_or("bits").alias("bits")), words


def passing(rows: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """Rows whose ``fp`` the filter holds; no row is shuffled."""
    mixed, word, bits = _filter_places(F.col("fp"), words)
    tried = rows.select("*", mixed).select("*", word, bits.alias("own"))
    return tried.join(F.broadcast(found), "word").where(F.col("bits").bitwiseAND(F.col("own")) == F.col("own")).select(*rows.columns)
