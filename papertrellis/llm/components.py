"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papertrellis.llm.tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them; edges run from larger to smaller."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(fp, root): every node of the edge table (a long, b long) with the smallest node it can reach.

    Each round is written to the shared folder, so the plan stays short and a lost executor repeats one round at most.
    The rounds end when the edges no longer change, after about the square of the logarithm of the longest path.
    """
    now = written(edges.where("a <> b").distinct(), "components")
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), "components")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
