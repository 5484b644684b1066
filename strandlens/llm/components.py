"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandlens.llm.store import forget, keep


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """Columns node, root (the smallest node reached), for every node of links (a, b).

    Large-star and small-star rounds: each node's larger neighbours, then its smaller ones, are tied to its smallest
    neighbour, until every link points to a root. Each round is written, so that lost executors cost one round, and the round
before it is removed.
    Null ends and loops are dropped; an empty table has no nodes.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = keep(links.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links")
    for _ in range(most):
        if now.isEmpty():
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = keep(small, "links")
        forget(now)
        now = new
        # settled when every node has one link and no root is itself linked
        rooted = new.join(new.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()
        if rooted and new.groupBy("u").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"links are not settled after {most} rounds")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
