"""Connected components by alternating stars over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root), root the least node of its component, for every node of an edge (a, b), a <> b.

    Each half round replaces edges by edges to the least neighbour (large star: of larger
    neighbours, small star: of smaller ones), which keeps components; the number of rounds grows
    with the logarithm of the longest path.  Minima are combined before the shuffle and written,
    so the join back is a plain join whose hot nodes adaptive execution splits."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    state = _state(now)
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _star(both, F.col("v") > F.col("u"), False)
        now = _star(now, F.lit(True), True)
        after = _state(now)
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, moves, small: bool) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
    joined = edges.join(least, "u")
    out = joined.where(moves).select(F.col("v").alias("x"), "m")
    if small:
        out = out.unionByName(least.select(F.col("u").alias("x"), "m"))
    out = out.where("x <> m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v"))
    return written(out.distinct(), "cc")
