"""A tree of nodes with typed edges: ancestors, siblings, related nodes, expansion of hits.

nodes: node_id, parent_id. edges: source_id, target_id, type. Node ids are unique (deduplicate first); edges to nodes
that do not exist lead nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relationship types that an expansion follows.
RELATED = ["references", "amends", "replaces", "defines", "applies_to", "related_to"]
MAX_DEPTH = 10


def _chains(starts: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """node_id, chain: the ancestors, nearest first and at most depth, of each of starts (node_id, distinct) that is a node.

    Starts share their parents, and those theirs: each level looks up its distinct parents only, which also tells whether they
    exist, and chains are put together from the top down.
    """
    none = F.array().cast(f"array<{nodes.schema['node_id'].dataType.simpleString()}>")
    if depth <= 0:
        return starts.join(nodes.select("node_id"), "node_id", "left_semi").select("node_id", none.alias("chain"))
    own = starts.join(nodes.select("node_id", "parent_id"), "node_id").select("node_id", F.col("parent_id").alias("above"))
    higher = _chains(own.where("above IS NOT NULL").select(F.col("above").alias("node_id")).distinct(), nodes, depth - 1)
    joined = own.join(higher.select(F.col("node_id").alias("above"), F.col("chain").alias("higher")), "above", "left")
    return joined.select("node_id", F.when(F.col("higher").isNull(), none).otherwise(_upwards("above", "higher")).alias("chain"))


def _upwards(above: str, higher: str) -> Column:
    """A parent and its chain; in a cycle the walk stops before it would meet the parent again."""
    again = F.array_position(higher, F.col(above)).cast("int")
    return F.concat(F.array(above), F.when(again > 0, F.slice(higher, F.lit(1), again - 1)).otherwise(F.col(higher)))


def ancestors(seeds: DataFrame, nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """node_id, ancestor_id, depth: the walk up from each seed (node_id), ended by the depth, a missing parent or a cycle.

    In a cycle the start itself may reappear once, as an ancestor. Levels without nodes are empty relations, which adaptive
    execution takes out of the plan.
    """
    found = seeds.select("node_id").join(_chains(seeds.select("node_id").distinct(), nodes, max_depth), "node_id")
    return found.select("node_id", F.posexplode("chain").alias("_d", "ancestor_id")).select("node_id", "ancestor_id", (F.col("_d") + 1).alias("depth"))


def children(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    return seeds.select("node_id").join(nodes.select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id")), "node_id")


def siblings(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, sibling_id: the parent's other children."""
    own = seeds.select("node_id").join(nodes.select("node_id", "parent_id"), "node_id")
    return own.join(nodes.select("parent_id", F.col("node_id").alias("sibling_id")), "parent_id").where(F.col("sibling_id") != F.col("node_id")).select("node_id", "sibling_id")


def related(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, types: list[str] = RELATED, keep: list[str] = ()) -> DataFrame:
    """node_id, related_id, type: targets of outgoing edges of these types that exist. keep: columns of seeds to go on with."""
    wanted = edges.where(F.lower("type").isin([t.lower() for t in types])).select(F.col("source_id").alias("node_id"), F.col("target_id").alias("related_id"), F.col("type"))
    return seeds.select(*keep, "node_id").join(wanted, "node_id").join(nodes.select(F.col("node_id").alias("related_id")), "related_id", "left_semi").select("node_id", *keep, "related_id", "type")


def expand_hits(hits: DataFrame, nodes: DataFrame, edges: DataFrame, max_total: int, max_children: int = 10, max_depth: int = MAX_DEPTH, group: list[str] = ()) -> DataFrame:
    """Each hit (node_id, seed_ord, a whole number) with its parent, ancestors, first children and related nodes: node_id, label, seed_ord.

    A node is listed once, under the first label that reaches it (hits in order; in a hit: retrieved, parent, ancestor,
    child, related by type). No further hit is expanded once max_total nodes are there; the hit that reaches it is whole.
    group: columns of hits that keep several result lists apart. Edges may repeat.

    Hits of a list that share a parent share all above it, so only the first of them goes up. What is reached is brought
    together once, by list: nodes are listed and counted where a list's rows lie.
    """
    g = list(group)
    hits = hits.select(*g, "seed_ord", "node_id")
    seeds = hits.join(nodes.select("node_id"), "node_id", "left_semi")
    first_under = hits.join(nodes.select("node_id", "parent_id"), "node_id").where("parent_id IS NOT NULL").groupBy(*g, "parent_id").agg(F.min("seed_ord").alias("seed_ord"))
    chains = _chains(first_under.select(F.col("parent_id").alias("node_id")).distinct(), nodes, max_depth - 1).select(F.col("node_id").alias("parent_id"), "chain")
    up = first_under.join(chains, "parent_id").select(*g, "seed_ord", F.posexplode(_upwards("parent_id", "chain")).alias("pos", "node_id"))
    under = nodes.select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id")).join(hits.select("node_id"), "node_id", "left_semi")
    down = under.withColumn("pos", F.row_number().over(Window.partitionBy("node_id").orderBy("child_id"))).where(F.col("pos") <= max_children).join(seeds, "node_id")
    side = related(seeds, edges, nodes, keep=[*g, "seed_ord"])
    reached = (
        seeds.select(*g, "seed_ord", "node_id", F.lit("retrieved").alias("label"), F.lit(0).alias("kind"), F.lit(0).alias("pos"))
        .union(up.select(*g, "seed_ord", "node_id", F.when(F.col("pos") == 0, "parent").otherwise("ancestor"), F.when(F.col("pos") == 0, 1).otherwise(2), "pos"))
        .union(down.select(*g, "seed_ord", "child_id", F.lit("child"), F.lit(3), "pos"))
        .union(side.select(*g, "seed_ord", "related_id", "type", F.lit(4), F.lit(0)))
    )
    listed = reached.repartition(*g) if g else reached
    first = listed.withColumn("_n", F.row_number().over(Window.partitionBy(*g, "node_id").orderBy("seed_ord", "kind", "pos", "label"))).where(F.col("_n") == 1).drop("_n")
    # nodes listed before a hit decide whether it is expanded at all; kept with each node, so the list is not joined with itself
    before = F.count(F.lit(1)).over(Window.partitionBy(*g).orderBy("seed_ord").rangeBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_before", before).where(F.col("_before") < max_total).select(*g, "node_id", "label", "seed_ord")


def neighbours(edges: DataFrame, a: str, b: str, most: int = 12) -> DataFrame:
    """node, neighbours (array, ascending, at most `most`) of an undirected graph.

    Edges may repeat. They are ranked as they are, each task keeps a node's first ones and sends only those: sorts spill, where
    a hash table of all edges would have to be held to make them distinct.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour")).union(edges.select(F.col(b), F.col(a)))
    first = both.withColumn("_rank", F.dense_rank().over(Window.partitionBy("node").orderBy("neighbour"))).where(F.col("_rank") <= most)
    return first.groupBy("node").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))
