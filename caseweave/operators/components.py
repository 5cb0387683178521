"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import materialize, skew_safe_join

PART_ROWS = 100_000
# A node is a hub if it has at least HUB_LINKS links and at least 1 / HUBS of all ends of links, so there are at most HUBS, which bounds their broadcast.
HUBS = 10_000
HUB_LINKS = 3
# Every so many rounds hubs are ranked like all other nodes, which keeps the number of rounds logarithmic whatever the shape.
PLAIN_ROUND = 3


def _order(seed: int, node: Column, rank: Column) -> Column:
    """Per-round order of nodes: larger hubs first, then pseudo-random; the node itself breaks hash ties."""
    return F.struct(rank.alias("r"), F.xxhash64(F.lit(seed), node).alias("h"), node.alias("node"))


def _firsts(live: DataFrame, ends: int, seed: int) -> DataFrame:
    """(from, to): every node and the first of its closed neighbourhood."""
    both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = max(HUB_LINKS, -(-ends // HUBS))
    plain = F.lit(0).cast("bigint")
    if seed % PLAIN_ROUND == 0:
        ranked, own = both.withColumn("rank", plain), plain
    else:
        hubs = both.groupBy("v").agg((-F.count(F.lit(1))).alias("hub")).where(F.col("hub") <= -least)
        ranked = both.join(F.broadcast(hubs), "v", "left").withColumn("rank", F.coalesce("hub", plain))
        own = F.when(F.col("n") >= least, -F.col("n")).otherwise(plain)
    first = ranked.groupBy("u").agg(F.min(_order(seed, F.col("v"), F.col("rank"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return first.select(F.col("u").alias("from"), F.least(_order(seed, F.col("u"), own), F.col("m"))["node"].alias("to"))


def connected_components(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """(node, component) where ``component`` is the lowest node of the component.

    Each round maps every node to the first of its closed neighbourhood and contracts the graph. Hubs come first, so that what hangs on a
    hub is gone after one round; all others come in a fresh hash order, which removes a constant share of the nodes per round whatever the
    shape, so the number of rounds grows with the logarithm of the node count. Minima are partially aggregated and parallel edges vanish
    after each contraction. Runs one write per round for the mapping and one for the links that are left.
    """
    live = materialize(edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")))
    # Later tables have no more rows than this one; they are cut into parts of PART_ROWS.
    rows = left = live.count()

    def stored(df: DataFrame) -> DataFrame:
        return materialize(df.coalesce(max(1, -(-2 * rows // PART_ROWS))))

    mappings: list[DataFrame] = []
    while left:
        mapping = stored(_firsts(live, 2 * left, len(mappings) + 1))
        mappings.append(mapping)
        moved = (
            live.join(mapping.withColumnsRenamed({"from": "u", "to": "a"}), "u")
            .join(mapping.withColumnsRenamed({"from": "v", "to": "b"}), "v")
            .where(F.col("a") != F.col("b"))
        )
        live = stored(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        left = live.count()
    every = nodes.select(F.col(node).alias("from")).distinct()
    if not mappings:
        return every.select(F.col("from").alias(node), F.col("from").alias("component"))
    roots = mappings[-1].withColumnRenamed("to", "root")
    for mapping in reversed(mappings[:-1]):
        later = roots.withColumnsRenamed({"from": "mid"})
        roots = stored(mapping.withColumnRenamed("to", "mid").join(later, "mid", "left").select("from", F.coalesce("root", "mid").alias("root")))
    placed = materialize(every.join(roots, "from", "left").select("from", F.coalesce("root", "from").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("from").alias("component"))
    return skew_safe_join(placed, lowest, ["root"]).select(F.col("from").alias(node), "component")
