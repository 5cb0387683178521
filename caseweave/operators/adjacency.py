"""Neighbour lookups on edges that are stored by node.

``store_adjacency`` writes every edge under both of its ends into a table bucketed and sorted by node. A hop then never moves an edge: a short frontier is a list in
the scan, which opens only the buckets of its nodes and skips the row groups between them; a longer one is dealt to the buckets, where it meets the stored
edges. The edges that a hop reads are written once, so the cost follows the frontier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scale import materialize, shared_folder

BUCKETS = 64
#: Nodes of a frontier that become a list in the scan.
LISTED = 500


def store_adjacency(edges: DataFrame, buckets: int = BUCKETS, name: str | None = None) -> str:
    """Write the edges (source, target, more) under both ends; the table's name. A loop is stored once."""
    spark = edges.sparkSession
    name = name or f"adjacency_{uuid.uuid4().hex}"
    turned = edges.where("source <> target").select(F.col("target").alias("node"), F.lit(False).alias("outgoing"), *edges.columns)
    both = edges.select(F.col("source").alias("node"), F.lit(True).alias("outgoing"), *edges.columns).unionByName(turned)
    path = f"{shared_folder(spark).rstrip('/')}/caseweave/{name}"
    both.where("node is not null").repartition(buckets, "node").write.bucketBy(buckets, "node").sortBy("node").option("path", path).saveAsTable(name)
    return name


def neighbours(spark: SparkSession, name: str, frontier: DataFrame, relation: str | None = None, listed: int = LISTED) -> DataFrame:
    """The stored rows of the nodes in ``frontier`` (column id): their edges, under ``node``."""
    stored = spark.table(name)
    stored = stored if relation is None else stored.where(F.col("relation") == relation)
    wanted = frontier.select(F.col("id").alias("node")).where("node is not null").distinct()
    first = [r[0] for r in wanted.limit(listed + 1).collect()]
    if len(first) <= listed:
        return stored.where(F.col("node").isin(first))
    return stored.join(wanted, "node", "left_semi").select(*stored.columns)


def edges_of(spark: SparkSession, name: str, frontier: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges that touch a node of ``frontier`` at either end, each once. An edge between two of them is read under both and kept under its source."""
    read = neighbours(spark, name, frontier, relation)
    return read.drop("node", "outgoing").distinct()


def k_hop(spark: SparkSession, name: str, start: DataFrame, hops: int = 2, relation: str | None = None, listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """(nodes with their hop, distinct edges) reachable from ``start`` (column id) in ``hops`` steps, as ``graph.k_hop`` gives them."""
    columns = [c for c in spark.table(name).columns if c not in ("node", "outgoing")]
    visited = materialize(start.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier, collected = visited.select("id"), spark.table(name).select(*columns).limit(0)
    for hop in range(1, hops + 1):
        read = materialize(neighbours(spark, name, frontier, relation, listed))
        collected = collected.unionByName(read.select(*columns))
        ends = read.select(F.when(F.col("outgoing"), F.col("target")).otherwise(F.col("source")).alias("id")).distinct()
        fresh = materialize(ends.join(visited, "id", "left_anti").withColumn("hop", F.lit(hop)))
        visited, frontier = visited.unionByName(fresh), fresh.select("id")
        if fresh.isEmpty():
            break
    return visited, collected.distinct()
