"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014), as joins.

Every round is two shuffles of the links; a node with very many links is spread by Spark's skew join, since the other
side has one row a node. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links have a < b. Each node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return (
        moved.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        .union(least.select(F.col("m").alias("a"), "b"))
        .distinct()
    )


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """From links (a, b) of one orderable type: node, component (the least node reachable). Null ends and loops are left out.

    Nodes without a link have no row. The result is a table in work.
    """
    now = work.table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        then = work.table(_small_star(_large_star(now)), "links")
        found = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(now)
        now = then
        if found == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        seen = found
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
