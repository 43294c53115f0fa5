"""Row windows over one very long series, in chunks with a halo.

A series is cut by date into chunks. Each gets copies of the rows before it
that its windows reach, its halo, and is then a series of its own, so that one
symbol is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def with_halo(bars: DataFrame, *, halo: int, days: int, keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """``bars`` with ``chunk`` (days since 1970 over ``days``) and ``in_halo``; a row occurs in its own chunk, and in every later one that it is among the ``halo`` rows before.

    Only counts by chunk are followed along a whole series. A chunk with few
    rows is bridged: the rows that a later chunk needs come from as many
    earlier ones as it takes.
    """
    plain = bars.withColumn("chunk", F.floor(F.unix_date(order) / days))
    counts = plain.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("__n"))
    line = Window.partitionBy(*keys).orderBy("chunk")
    upto = F.sum("__n").over(line.rowsBetween(Window.unboundedPreceding, 0))
    later = F.collect_list(F.struct("chunk", (F.col("__upto") - F.col("__n")).alias("before"))).over(line.rowsBetween(1, halo))  # a chunk has a row at least
    reach = counts.withColumn("__upto", upto).withColumn("__later", later).select(*keys, "chunk", "__upto", F.filter("__later", lambda x: x["before"] - F.col("__upto") < halo).alias("__later"))
    back = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(F.desc(order)))
    placed = plain.withColumn("__back", back).join(reach, [*keys, "chunk"])
    wanted = F.filter("__later", lambda x: x["before"] - F.col("__upto") + F.col("__back") <= halo)
    own = F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("in_halo")))
    copies = F.transform(wanted, lambda x: F.struct(x["chunk"].alias("chunk"), F.lit(True).alias("in_halo")))
    return placed.withColumn("__to", F.explode(F.concat(own, copies))).select(*bars.columns, "__to.chunk", "__to.in_halo")


def in_chunks(bars: DataFrame, of: Callable[[DataFrame], DataFrame], *, halo: int = 200, days: int = 3650) -> DataFrame:
    """``of(bars)`` for an operator of row windows by symbol that look back over ``halo`` rows at most, chunk by chunk.

    ``of`` must give symbol and date of every row; it sees a chunk as a symbol.
    """
    cut = with_halo(bars, halo=halo, days=days)
    named = cut.withColumns({"__name": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", "chunk")})
    marks = named.where("NOT in_halo").select("symbol", "date", "__name")
    got = of(named.drop("chunk", "in_halo", "__name"))
    return got.join(marks, ["symbol", "date"]).withColumn("symbol", F.col("__name")).select(*got.columns)
