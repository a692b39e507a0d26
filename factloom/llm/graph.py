"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``: the least node that it is linked with.

    Each round joins every node with the least of its neighbours; a number of
    rounds that grows with the logarithm of the longest chain is enough.  Self
    links and repeated links are ignored; no edges give no rows.
    """
    links = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        mark = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
        if not mark[0]:
            break
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.union(near.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return out.union(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
