"""Keyed tables on append-only Parquet: lookups, inserts, updates and graph upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import stored_edge_id, stored_node_id


class Store:
    """Named Parquet tables below one folder. Rows are only ever appended; the current state of a
    key is its newest row."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def seed(self, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(name))

    def insert(self, table: str, rows: DataFrame, now: Column) -> None:
        stamped(rows, now).write.mode("append").parquet(self.path(table))

    def find(self, table: str, predicate: Column | None = None) -> DataFrame:
        df = self.read(table)
        return df if predicate is None else df.where(predicate)

    def find_many(self, table: str, limit: int | None = None, order_by: str = "created_at", descending: bool = True, key: str | None = None, **filters) -> DataFrame:
        df = matching(self.read(table), **filters)
        order = F.col(order_by).desc() if descending else F.col(order_by).asc()
        ordered = df.orderBy(order, *([key] if key else []))
        return ordered if limit is None else ordered.limit(limit)

    def find_one(self, table: str, column: str, value) -> DataFrame:
        return self.read(table).where(F.col(column).cast("string") == str(value)).limit(1)

    def update(self, table: str, rows: DataFrame, now: Column) -> None:
        """Append full rows that carry the change; ``latest_rows`` shows them as current."""
        rows.withColumn("updated_at", now).write.mode("append").parquet(self.path(table))

    def mirror(self, table: str, view: str) -> None:
        """A second name for a table; a view, not a second write."""
        self.read(table).createOrReplaceTempView(view)

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query)


def matching(df: DataFrame, **filters) -> DataFrame:
    """Equality filters in the type of each column."""
    out = df
    for column, value in filters.items():
        out = out.where(F.col(column) == F.lit(value).cast(df.schema[column].dataType))
    return out


def stamped(rows: DataFrame, now: Column, key: str | None = None) -> DataFrame:
    """Fill ``created_at``; with ``key`` also a row id derived from the row's content."""
    created = F.coalesce(F.col("created_at"), now) if "created_at" in rows.columns else now
    out = rows.withColumn("created_at", created)
    if key is None:
        return out
    made = F.lower(F.hex(F.xxhash64(*[F.col(c).cast("string") for c in rows.columns if c != key])))
    return out.withColumn(key, F.coalesce(F.col(key).cast("string"), made) if key in rows.columns else made)


def latest_rows(changes: DataFrame, keys: Sequence[str], stamp: str = "updated_at", tie: str | None = None) -> DataFrame:
    """Newest row per key. Each task keeps one row per key before the shuffle, so a key with a long
    history is cheap. Rows without a stamp count as oldest."""
    order = F.struct(stamp, tie) if tie else F.struct(stamp)
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), order).alias("_row"))
    return newest.select("_row.*")


def patched(current: DataFrame, patch: DataFrame, key: str, now: Column) -> DataFrame:
    """Current rows with the non-null fields of ``patch`` laid over them; only changed rows."""
    p = patch.withColumnsRenamed({c: f"_new_{c}" for c in patch.columns if c != key})
    joined = current.join(p, key)
    return joined.select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in p.columns else F.col(c)
            for c in current.columns
            if c != "updated_at"
        ],
        now.alias("updated_at"),
    )


def node_rows(df: DataFrame, node_type: Column, ref: Column, name: Column, now: Column) -> DataFrame:
    return df.select(
        stored_node_id(node_type, ref).alias("node_id"), node_type.alias("node_type"), ref.cast("string").alias("ref_id"),
        name.alias("display_name"), now.alias("created_at"), now.alias("updated_at"),
    )


NODE_KEYS = ["node_id", "node_type", "ref_id"]
# The ends, the relation and the incident follow from the id.
EDGE_KEYS = ["edge_id", "from_node_id", "to_node_id", "relation_type", "incident_id"]


def node_merge() -> list[Column]:
    """First creation time, newest name."""
    return [
        F.max_by("display_name", F.struct("updated_at", "display_name")).alias("display_name"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    ]


def edge_merge(add_weight: bool = True) -> list[Column]:
    """A repeat adds its weight, or keeps the largest when ``add_weight`` is off (replays then change nothing)."""
    weight = F.sum("weight") if add_weight else F.max("weight")
    return [weight.alias("weight"), F.min("created_at").alias("created_at")]


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables as one, a row per node. ``keyed.KeyedTable`` does the same to the buckets that ``new`` touches only."""
    return old.unionByName(new).groupBy(*NODE_KEYS).agg(*node_merge())


def edge_rows(df: DataFrame, incident: Column, source: Column, target: Column, relation: Column, now: Column, weight: Column | None = None) -> DataFrame:
    return df.select(
        stored_edge_id(incident, source, target).alias("edge_id"), source.cast("string").alias("from_node_id"),
        target.cast("string").alias("to_node_id"), relation.alias("relation_type"), incident.cast("string").alias("incident_id"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), now.alias("created_at"),
    )


def upsert_edges(old: DataFrame, new: DataFrame, add_weight: bool = True) -> DataFrame:
    """Edges by id."""
    return old.unionByName(new).groupBy(*EDGE_KEYS).agg(*edge_merge(add_weight))


def cross_incident_edges(edges: DataFrame) -> DataFrame:
    """Weight of a node pair across incidents."""
    return edges.groupBy("from_node_id", "to_node_id", "relation_type").agg(
        F.count_distinct("incident_id").alias("weight"), F.min("created_at").alias("created_at")
    )
