"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlab.llm.session import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("s")).first()
    return row["n"], row["s"] or 0


def components(edges: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """node, label (the smallest node reachable) for all nodes of the undirected edges a, b (long).

    Each step is a minimum by node, combined before the shuffle, and a join of
    the edges with it, so a node with very many edges is never gathered. The
    steps needed grow with the logarithm of the longest path. A step runs in as
    many tasks as its edges need, ``rows_per_task`` in each. Null ends and loops
    are ignored.
    """
    cur = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(cur)
    while state[0]:
        tasks = 1 + 2 * state[0] // rows_per_task
        cur = cur.coalesce(tasks)
        # large star: larger neighbours of a node go to its smallest one
        both = cur.union(cur.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        # small star: a node and its smaller neighbours go to the smallest one
        small = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        met = large.join(small, "a")
        moved = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct()
        cur = checkpointed(moved.coalesce(tasks))
        now = _state(cur)
        if now == state:
            break
        state = now
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(stars.select("label", "label").distinct())
