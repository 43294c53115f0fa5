"""Shards with the corpus' mixture: proportional stratified interleaving.

1. A row's shuffle key is a seeded hash of its id and text. Within its source,
   a row's rank r (from 1) is its place by that key, and its fractional rank
   is (r - phase) / rows of the source, with a seeded phase between 0 and 1
   for each source, so that sources of a single row do not all fall together.
2. All rows in the order of their fractional ranks hold the sources in equal
   proportions throughout: below a fraction f lie f n rows of a source with n
   rows, within one, and so f N rows of all, within the number of sources.
3. The order is cut into equal stretches: shard sizes differ by one row at
   most. Of N rows from s sources, a shard of m has n m / N of a source with n
   rows, within 2 + 2 s n / N (in practice the root of s, not s).

Neither order is ever sorted in one task. With N rows, the shuffle keys are cut
into about sqrt(N) equal ranges, so that (source, range) holds about sqrt(N)
rows for the largest source; its rows are numbered there, and the counts of the
ranges before are added. Fractional ranks are spread evenly by construction
and are cut and numbered likewise. Only rows of numbers are shuffled, no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barlab.llm.session import checkpointed

#: Bits of the shuffle key that choose its range, and all of its bits (15 hexadecimal digits).
_RANGE_BITS, _KEY_BITS = 30, 60
_ROW_BYTES = 8


def _hashed(seed: int, *parts) -> F.Column:
    """60 bits of an MD5 of the seed and the parts, as long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, _KEY_BITS // 4), 16, 10).cast("long")


def shards(docs: DataFrame, *, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    ``size``: UTF-8 bytes of the text and 8 more. Shards are numbered from 0,
    slots from 0 without gaps in each. The result depends on ids, texts and
    sources only, not on where rows lie: rows equal in all three tie, and
    whichever comes first, the result has the same rows. A null text counts as
    empty, null sources are a source of their own; a row with a null id is
    shuffled by its place in the scan instead. Other columns are ignored,
    whatever their names. An empty table gives no rows; with fewer rows than
    shards some shards are empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = F.col(source_col).cast("string")
    plain = docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("stratum"),
        (F.octet_length(text) + _ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id())).alias("name"),
    )
    rows = checkpointed(plain.withColumn("key", _hashed(seed, F.col("name"), F.col("text_crc32"), F.col("size"))))
    n = rows.count()
    cuts = max(1, round(n**0.5))

    cut = F.shiftright(F.shiftright("key", _KEY_BITS - _RANGE_BITS) * cuts, _RANGE_BITS)
    keyed = rows.withColumn("cut", cut)
    by_source = Window.partitionBy("stratum")
    upto = by_source.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("stratum", "cut").agg(F.count(F.lit(1)).alias("n")).select("stratum", "cut", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(by_source).alias("of_source"))
    within = Window.partitionBy("stratum", "cut").orderBy("key", "name", "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(within)
    phase = (F.shiftright(_hashed(seed, F.col("stratum")), _KEY_BITS - _RANGE_BITS) + 0.5) / float(1 << _RANGE_BITS)
    fraction = (rank - phase) / F.col("of_source")
    ranked = checkpointed(keyed.join(counts, ["stratum", "cut"]).withColumn("fraction", fraction).drop("cut", "before", "of_source"))

    placed = ranked.withColumn("cut", F.least(F.floor(F.col("fraction") * cuts), F.lit(cuts - 1)))
    stretches = placed.groupBy("cut").agg(F.count(F.lit(1)).alias("n")).select("cut", F.coalesce(F.sum("n").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("cut").orderBy("fraction", "stratum", "key", "name", "text_crc32", "size")
    place = placed.withColumn("number", F.row_number().over(order)).join(stretches, "cut").withColumn("place", F.col("before") + F.col("number") - 1)
    shard = F.expr(f"place * {shards} div {max(1, n)}")
    first = F.expr(f"(shard * {max(1, n)} + {shards - 1}) div {shards}")
    return place.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


_POLYNOMIAL = 0xEDB88320


def _crc_byte(value: str) -> str:
    """SQL of the eight steps of CRC-32 for one byte already mixed in."""
    return f"list_reduce(list_prepend({value}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, {_POLYNOMIAL} * (c & 1)))"


ORACLE = f"""
WITH b AS (SELECT doc_id, source, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
tab AS (SELECT list(crc ORDER BY i) AS crcs FROM (SELECT i, {_crc_byte('i')} AS crc FROM range(256) r(i))),
c AS (SELECT doc_id, source, strlen(body) + {_ROW_BYTES} AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM b, tab),
k AS (SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, ('0x' || substr(md5('42:' || doc_id || ':' || text_crc32 || ':' || size), 1, 15))::BIGINT AS key FROM c),
f AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id::VARCHAR) - ((('0x' || substr(md5('42:' || stratum), 1, 15))::BIGINT >> 30) + 0.5::DOUBLE) / 1073741824.0::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS fraction FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, key, doc_id::VARCHAR) - 1 AS place, count(*) OVER () AS n FROM f),
s AS (SELECT *, place * 24 // n AS shard FROM p)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
