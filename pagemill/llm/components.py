"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.skew import join_counted
from pagemill.llm.storage import Stash


def _is_starred(e: DataFrame) -> bool:
    """Whether every node is either a root or has exactly one edge, to a root."""
    role = e.select(F.col("b").alias("node"), F.col("a").alias("up")).union(e.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("up")).distinct())
    seen = role.groupBy("node").agg(F.count("up").alias("ups"), F.count("*").alias("n"), F.min("up").alias("lo"), F.max("up").alias("hi"))
    return seen.where("ups > 0 and (n > ups or lo < hi)").isEmpty()


def components(edges: DataFrame, stash: Stash, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the least node that can be reached.

    Large-star and small-star rounds alternate until the edges are stars. A node's neighbours are never
    gathered: each star is a grouped minimum and a join with it, which spreads the largest stars.
    """
    e = stash.put("cc", edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    for _ in range(most_rounds):
        if _is_starred(e):
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        # large-star: each node links its greater neighbours with the least of its neighbours and itself
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash.put("low", both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = join_counted(both.where("b > a"), low, "a", ["b"]).select(F.col("m").alias("a"), "b").where("a < b")
        large = stash.put("large", large.distinct())
        # small-star: each node links its smaller neighbours, and itself, with the least of them
        low = stash.put("low", large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")))
        small = join_counted(large, low, "b", ["a"]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        done = stash.put("cc2", small)
        stash.drop("cc", "low", "large")
        stash.paths["cc"] = stash.paths.pop("cc2")
        e = done
    raise RuntimeError("components did not settle")
