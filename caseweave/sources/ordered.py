"""Result tables that keep an order.

``write_ordered`` sorts by range: every task writes one file of consecutive rows, and file numbers follow the order. Beside the rows lies one small
row per file with the number of rows before it, so a row's position is that number plus its place in the file; no task sees more than its own
range. ``read_ordered`` gives the position, ``page`` opens only the files that hold the wanted positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The orders of the surveyed result tables; ties go to the keys.
ORDERS = {
    "cluster_stats": "number_of_incidents DESC, cluster_id",
    "cluster_assignments": "cluster_id, incident_id",
    "trend_summary": "district, crime_type, date",
    "anomalies": "abs(z_score) DESC, district, crime_type, date",
    "spike_events": "peak_incident_count DESC, district, crime_type, spike_start",
    "statistics": "total_incidents DESC, district, crime_type",
    "district_ranking": "rank_by_incidents, district",
    "risk_scores": "risk_score DESC, district",
    "risk_feature_importance": "normalized_weight DESC, feature",
    "incident_anomalies": "anomaly_score, incident_id",
    "similar_incidents": "incident_id, similarity_score DESC, matched_incident_id",
    "flags": "created_at DESC, flag_id",
    "hotspots": "risk_score DESC, hotspot_id",
}


def order_of(table: str) -> list[Column]:
    terms = [t.strip() for t in ORDERS[table].split(",")]
    return [F.expr(t.removesuffix(" DESC")).desc_nulls_last() if t.endswith(" DESC") else F.expr(t).asc_nulls_last() for t in terms]


def write_ordered(df: DataFrame, folder: str, order: Sequence[Column]) -> str:
    rows, before = f"{folder}/rows", f"{folder}/before"
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    df.orderBy(*order).withColumns({"_file": F.spark_partition_id(), "_place": place}).write.parquet(rows)
    counts = df.sparkSession.read.parquet(rows).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # One row per file: the window holds as many rows as the sort had tasks.
    earlier = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    counts.select("_file", F.coalesce(earlier, F.lit(0)).alias("_before"), "_n").coalesce(1).write.parquet(before)
    return folder


def read_ordered(spark: SparkSession, folder: str, position: str = "position") -> DataFrame:
    """The rows with their position from 1."""
    rows, before = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/before")
    placed = rows.join(F.broadcast(before), "_file").withColumn(position, F.col("_before") + F.col("_place") + 1)
    return placed.drop("_file", "_place", "_before", "_n")


def page(spark: SparkSession, folder: str, first: int, size: int, position: str = "position") -> DataFrame:
    """The rows at positions ``first`` to ``first + size - 1``, in order."""
    before = spark.read.parquet(f"{folder}/before").where((F.col("_before") < first - 1 + size) & (F.col("_before") + F.col("_n") >= first))
    files = [r[0] for r in before.select("_file").collect()]
    names = [n for n in spark.read.parquet(f"{folder}/rows").inputFiles() if int(n.rpartition("/part-")[2].split("-")[0]) in files]
    if not names:
        return read_ordered(spark, folder, position).limit(0)
    rows = spark.read.parquet(*names).join(F.broadcast(before), "_file").withColumn(position, F.col("_before") + F.col("_place") + 1)
    return rows.where(F.col(position).between(first, first + size - 1)).drop("_file", "_place", "_before", "_n").orderBy(position)
