"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import remove, written_at


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    `edges` holds longs `a` and `b`; direction, loops and repetitions do not matter, rows with a null are ignored.
    Large and small stars alternate until nothing changes, which takes about log(nodes) rounds whatever the diameter.
    Each round is written to the shared folder, so plans do not grow and lost executors cost one round at most.
    Minima combine before the shuffle, and the joins are plain equi-joins, so AQE splits the rows of a hub.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    now, path = written_at(ends.distinct(), "edges")
    state = _state(now)
    while True:
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = now.select(F.col("b").alias("u"), F.col("a").alias("v")).union(now.select("a", "b"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: a node and its neighbours below move to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(least, "b")
        small = moved.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").union(least.select(F.col("m"), F.col("b")))
        old = path
        now, path = written_at(small.distinct(), "edges")
        remove(edges.sparkSession, old)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and two sums of hashes; equal sets of edges have equal states."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
