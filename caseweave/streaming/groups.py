"""Connected components that grow with a stream of links.

Three keyed tables hold the components: ``labels`` gives each node the label it got when it came, for good; ``roots`` gives each label the
component it now stands for; ``named`` lists the labels of a component. A batch looks up the ends of its links, contracts them to the
components they belong to, and finds the components of that small graph. New nodes are added, and the labels of components that were joined to
another get its name; all other rows stay as they are. What a batch reads and writes follows its own nodes and the labels of the components it
joins, not the table. A component is named by its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.scale import materialize
from ..sources.keyed import BUCKETS, KeyedTable, compact_every
from .tables import run_available

COMPACT_EVERY = 8


class Groups:
    def __init__(self, spark: SparkSession, folder: str, node_type: str = "string", buckets: int = BUCKETS) -> None:
        def least(name: str):
            return lambda: [F.min(name).alias(name)]

        t = node_type
        self.labels = KeyedTable(spark, f"{folder}/labels", f"node {t}, label {t}", ["node"], least("label"), buckets=buckets)
        self.roots = KeyedTable(spark, f"{folder}/roots", f"label {t}, root {t}", ["label"], least("root"), buckets=buckets)
        self.named = KeyedTable(spark, f"{folder}/named", f"root {t}, label {t}, n bigint", ["root", "label"], least("n"), buckets=buckets)

    def tables(self) -> list[KeyedTable]:
        return [self.labels, self.roots, self.named]

    def add(self, links: DataFrame, batch: int, src: str = "source", dst: str = "target", nodes: DataFrame | None = None) -> None:
        """Add the links of a batch, and ``nodes`` (a column ``node``) that may have none. What is there from this batch on is replaced."""
        compact_every(self.tables(), batch, COMPACT_EVERY)
        before = batch - 1  # a replay sees what the first try saw
        pairs = materialize(links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct())
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node"))
        ends = materialize((ends if nodes is None else ends.unionByName(nodes.select("node").where("node is not null"))).distinct())
        known = materialize(self.labels.lookup(ends, before))
        placed = materialize(
            ends.join(known, "node", "left").join(self.roots.lookup(known.select("label"), before), "label", "left")
            .select("node", F.col("root").alias("old"), F.coalesce("root", "node").alias("at"))
        )
        at = placed.select("node", "at")
        joined = pairs.join(at.toDF("u", "a"), "u").join(at.toDF("v", "b"), "v").where("a <> b").select("a", "b").distinct()
        found = materialize(connected_components(joined, placed.select("at"), "a", "b", "at"))
        moved = found.where("at <> component")
        changed = self.named.lookup(moved.select(F.col("at").alias("root")), before).join(moved.withColumnRenamed("at", "root"), "root").select("label", "component")
        fresh = materialize(placed.where("old is null").join(found, "at").select("node", "component"))
        now = materialize(changed.unionByName(fresh.select(F.col("component").alias("label"), "component")).distinct())
        self.labels.append(fresh.select("node", F.col("component").alias("label")), batch)
        self.roots.append(now.select("label", F.col("component").alias("root")), batch)
        self.named.append(now.select(F.col("component").alias("root"), "label", F.lit(1).cast("bigint").alias("n")), batch)

    def current(self) -> DataFrame:
        """(node, component) of all nodes so far."""
        return self.labels.read().join(self.roots.read(), "label").select("node", F.col("root").alias("component"))


def run_components(links: DataFrame, folder: str, checkpoint: str, src: str = "source", dst: str = "target", buckets: int = BUCKETS) -> None:
    """Keep the components of a stream of links below ``folder``."""
    groups = Groups(links.sparkSession, folder, links.schema[src].dataType.simpleString(), buckets)
    run_available(links.writeStream.foreachBatch(lambda df, batch: groups.add(df, batch, src, dst)), checkpoint)
