"""Density clustering of incident coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import require_all, require_columns
from .cleaning import clean_coordinates
from .components import connected_components
from .radius import Grid, counts_within, distinct_points, linked_entities
from .scale import dense_index, materialize, skew_safe_join

CELL = ["band", "col"]
SPOT = ["latitude", "longitude"]


def check_parameters(eps_meters: float, min_samples: int) -> None:
    require_all(
        [(eps_meters > 0, "eps_meters must be > 0"), (min_samples >= 2, "min_samples must be >= 2")],
        "clustering parameters",
    )


def _cell_id():
    return F.shiftleft(F.col("band"), 32) + F.col("col")


def label_points(incidents: DataFrame, eps_meters: float = 300.0, min_samples: int = 10) -> DataFrame:
    """(latitude, longitude, cluster_id) of every clustered coordinate; noise is left out.

    Every cell's diagonal is at most eps, so all rows of a cell with ``min_samples`` rows are core
    and linked without any comparison. Only the few rows of thin cells are counted against their
    surroundings, and clusters are joined cell by cell. Writes intermediate tables.
    """
    check_parameters(eps_meters, min_samples)
    require_columns(incidents, ["incident_id", *SPOT])
    grid = Grid(eps_meters)
    points = materialize(distinct_points(incidents, grid))
    cells = points.groupBy(*CELL).agg(F.sum("mult").alias("cell_rows"))
    tagged = materialize(
        skew_safe_join(points, cells, CELL).withColumn("dense", F.col("cell_rows") >= min_samples).drop("cell_rows")
    )
    thin = tagged.where("NOT dense").drop("dense")
    found = counts_within(thin, points, grid, min_samples).where(F.col("found") >= min_samples).select(*SPOT)
    judged = materialize(
        tagged.join(found.withColumn("met", F.lit(True)), SPOT, "left")
        .withColumn("core", F.col("dense") | F.coalesce("met", F.lit(False)))
        .drop("dense", "met")
    )
    core = judged.where("core").drop("core")
    ahead = (F.col("a_band") < F.col("b_band")) | (
        (F.col("a_band") == F.col("b_band")) & (F.col("a_col") < F.col("b_col"))
    )
    links = linked_entities(core, core, grid, CELL, CELL, ahead).select(
        (F.shiftleft("a_band", 32) + F.col("a_col")).alias("u"), (F.shiftleft("b_band", 32) + F.col("b_col")).alias("v")
    )
    core_cells = core.groupBy(_cell_id().alias("cell")).agg(F.min("first_id").alias("first_id"))
    parts = connected_components(links, core_cells, "u", "v", "cell")
    firsts = parts.join(core_cells, "cell").groupBy("component").agg(F.min("first_id").alias("first_id"))
    numbered = dense_index(firsts, ["first_id"], "cluster_id").select("component", "cluster_id")
    cell_labels = materialize(skew_safe_join(parts, numbered, ["component"]).select("cell", "cluster_id"))
    edge_points = judged.where("NOT core").drop("core")
    reached = linked_entities(edge_points, core, grid, [*CELL, *SPOT], CELL).select(
        F.col("a_latitude").alias("latitude"), F.col("a_longitude").alias("longitude"),
        (F.shiftleft("b_band", 32) + F.col("b_col")).alias("cell"),
    )
    border = reached.join(cell_labels, "cell").groupBy(*SPOT).agg(F.min("cluster_id").alias("cluster_id"))
    inner = skew_safe_join(core.select(*SPOT, _cell_id().alias("cell")), cell_labels, ["cell"]).select(*SPOT, "cluster_id")
    return inner.unionByName(border)


def assign_clusters(incidents: DataFrame, eps_meters: float = 300.0, min_samples: int = 10) -> DataFrame:
    """Cleaned incidents with ``cluster_id``; -1 is noise.

    Labels number the clusters by their first core incident in id order. A border row takes the
    lowest label that reaches it.
    """
    clean = clean_coordinates(incidents)
    labels = label_points(clean, eps_meters, min_samples)
    return skew_safe_join(clean, labels, SPOT, "left").withColumn(
        "cluster_id", F.coalesce("cluster_id", F.lit(-1)).cast("bigint")
    )


def assignments(clustered: DataFrame) -> DataFrame:
    return clustered.select("incident_id", "cluster_id", "latitude", "longitude", "district")

