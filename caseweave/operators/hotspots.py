"""Cluster statistics, relative tiers and fixed-grid hotspots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.geo import grid_key, haversine_m
from .cleaning import without_noise
from .dbscan import assign_clusters, assignments
from .scale import exact_quantiles, materialize, skew_safe_join, value_modes

STAT_COLUMNS = [
    "cluster_id", "district", "centre_latitude", "centre_longitude", "number_of_incidents",
    "cluster_radius_metres", "cluster_radius_max_metres", "density", "most_common_crime",
    "severity_score", "risk_level", "unique_crime_types", "unique_offenders",
    "first_incident_date", "last_incident_date",
]


def cluster_centres(members: DataFrame) -> DataFrame:
    """Independent exact medians of latitude and longitude per cluster."""
    axes = members.select(
        "cluster_id",
        F.explode(
            F.array(
                F.struct(F.lit("lat").alias("axis"), F.col("latitude").alias("at")),
                F.struct(F.lit("lon").alias("axis"), F.col("longitude").alias("at")),
            )
        ).alias("e"),
    ).select("cluster_id", "e.axis", "e.at")
    medians = exact_quantiles(axes, "at", {"mid": 0.5}, ["cluster_id", "axis"])
    return medians.groupBy("cluster_id").agg(
        F.max(F.when(F.col("axis") == "lat", F.col("mid"))).alias("centre_lat"),
        F.max(F.when(F.col("axis") == "lon", F.col("mid"))).alias("centre_lon"),
    )


def cluster_radii(members: DataFrame, centres: DataFrame) -> DataFrame:
    """95th percentile and maximum distance to the centre."""
    far = skew_safe_join(members.select("cluster_id", "incident_id", "latitude", "longitude"), centres, ["cluster_id"]).select(
        "cluster_id",
        haversine_m(F.col("centre_lat"), F.col("centre_lon"), F.col("latitude"), F.col("longitude")).alias("d"),
    )
    p95 = exact_quantiles(far, "d", {"r95": 0.95}, ["cluster_id"])
    return p95.join(far.groupBy("cluster_id").agg(F.max("d").alias("rmax")), "cluster_id")


def cluster_statistics(clustered: DataFrame, points: dict[str, int] | None = None) -> DataFrame:
    """One row per cluster, without the relative tier."""
    members = without_noise(clustered)
    profile = members.groupBy("cluster_id", "crime_type", "district").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("occurrence_datetime").alias("first"),
        F.max("occurrence_datetime").alias("last"),
    )
    base = profile.groupBy("cluster_id").agg(
        F.sum("n").alias("number_of_incidents"),
        F.sum((F.col("n") * labels.severity_points(F.col("crime_type"), points)).cast("double")).alias("severity_score"),
        F.count_distinct("crime_type").alias("unique_crime_types"),
        F.min("first").alias("first_incident_date"),
        F.max("last").alias("last_incident_date"),
    )
    modes = value_modes(
        profile, ["cluster_id"], {"district": "district", "crime_type": "most_common_crime"}, F.col("n")
    )
    centres = cluster_centres(members)
    joined = base.join(modes, "cluster_id").join(centres, "cluster_id").join(cluster_radii(members, centres), "cluster_id")
    if "offender_id" in members.columns:
        people = members.groupBy("cluster_id").agg(F.count_distinct("offender_id").alias("unique_offenders"))
        joined = joined.join(people, "cluster_id", "left")
    density = F.when(
        F.col("r95") > 0, F.round(F.col("number_of_incidents") / (F.lit(math.pi) * F.col("r95") * F.col("r95")), 6)
    )
    shaped = joined.withColumns(
        {
            "centre_latitude": F.round("centre_lat", 6),
            "centre_longitude": F.round("centre_lon", 6),
            "cluster_radius_metres": F.round("r95", 2),
            "cluster_radius_max_metres": F.round("rmax", 2),
            "density": density,
        }
    )
    return shaped.select(*[c for c in STAT_COLUMNS if c in shaped.columns])


def relative_tiers(stats: DataFrame) -> DataFrame:
    """High / Medium / Low by tertiles of severity over this result; all equal gives Medium."""
    cuts = exact_quantiles(stats, "severity_score", {"low_cut": 1.0 / 3.0, "high_cut": 2.0 / 3.0})
    cut = cuts.select(F.struct("low_cut", "high_cut").alias("c")).scalar()
    spread = stats.agg((F.max("severity_score") > F.min("severity_score")).alias("v")).scalar()
    tiered = stats.withColumn("_c", cut).withColumn(
        "risk_level",
        F.when(~F.coalesce(spread, F.lit(False)), "Medium")
        .when(F.col("severity_score") >= F.col("_c.high_cut"), "High")
        .when(F.col("severity_score") >= F.col("_c.low_cut"), "Medium")
        .otherwise("Low"),
    )
    return tiered.select(*[c for c in STAT_COLUMNS if c in tiered.columns])


def hotspots(
    incidents: DataFrame, eps_meters: float = 300.0, min_samples: int = 10, points: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(assignments, cluster statistics) of the density clustering. Writes intermediate tables."""
    clustered = materialize(assign_clusters(incidents, eps_meters, min_samples))
    stats = materialize(cluster_statistics(clustered, points))
    return assignments(clustered), relative_tiers(stats)


CELL = ["_station", "cell_lat", "cell_lon"]


def _cells(incidents: DataFrame) -> DataFrame:
    return incidents.withColumns(
        {
            "_station": F.coalesce(F.col("police_station").cast("string"), F.lit("STATION")),
            "cell_lat": grid_key(F.col("latitude")),
            "cell_lon": grid_key(F.col("longitude")),
        }
    )


def _hotspot_id():
    return F.format_string(
        "HS_%s_%.2f_%.2f", F.col("_station"), F.col("cell_lat") / 100.0, F.col("cell_lon") / 100.0
    )


def grid_counts(incidents: DataFrame) -> DataFrame:
    """Counts per (station, cell, district, type) with the first incident's place.

    Only counters and numbers are aggregated, so each task reduces its rows in a hash map. Counts of
    different row sets can be united and given to ``hotspots_of_counts``.
    """
    return _cells(incidents).groupBy(*CELL, "district", "crime_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("incident_id").alias("first_id"),
        F.min_by("latitude", "incident_id").alias("latitude"),
        F.min_by("longitude", "incident_id").alias("longitude"),
    )


def count_merge() -> list[Column]:
    """What makes several rows of ``grid_counts`` with one key one row."""
    return [
        F.sum("n").alias("n"), F.min_by("latitude", "first_id").alias("latitude"), F.min_by("longitude", "first_id").alias("longitude"),
        F.min("first_id").alias("first_id"),
    ]


def hotspots_of_counts(counts: DataFrame, min_incidents: int = 3, scope: Sequence[str] = ()) -> DataFrame:
    """Cells with at least ``min_incidents`` rows. Members are not listed inside the row, where one
    busy cell would hold an unbounded array; see ``grid_members``."""
    grouped = counts.groupBy(*scope, *CELL).agg(
        F.sum("n").alias("incident_count"),
        F.min(F.struct("first_id", "latitude", "longitude", F.col("district").alias("place"))).alias("f"),
        F.array_sort(F.collect_set("crime_type")).alias("crime_types"),
    )
    return grouped.where(F.col("incident_count") >= min_incidents).select(
        _hotspot_id().alias("hotspot_id"),
        F.col("_station").alias("police_station"),
        F.col("f.place").alias("district"),
        F.col("f.latitude").alias("latitude"),
        F.col("f.longitude").alias("longitude"),
        "incident_count",
        "crime_types",
        F.round(F.least(F.lit(1.0), 0.4 + F.col("incident_count") * 0.1), 2).alias("risk_score"),
    )


def grid_hotspots(incidents: DataFrame, min_incidents: int = 3, per_district: bool = False) -> DataFrame:
    """Cells of 0.01 degree per station (and district) with at least ``min_incidents`` rows."""
    return hotspots_of_counts(grid_counts(incidents), min_incidents, ["district"] if per_district else [])


def grid_members(incidents: DataFrame, min_incidents: int = 3) -> DataFrame:
    """(hotspot_id, incident_id) for every row that lies in a grid hotspot."""
    celled = _cells(incidents)
    busy = celled.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_incidents).drop("n")
    kept = skew_safe_join(celled.select("incident_id", *CELL), busy, CELL, "left_semi")
    return kept.select(_hotspot_id().alias("hotspot_id"), "incident_id")


def district_forecast(incidents: DataFrame, default_district: str = "UNKNOWN") -> DataFrame:
    """Per district: all incidents, grid hotspots and their mean score (0 without any)."""
    scoped = incidents.withColumn("district", F.coalesce("district", F.lit(default_district)))
    totals = scoped.groupBy("district").agg(F.count(F.lit(1)).alias("total_incidents"))
    spots = (
        grid_hotspots(scoped, per_district=True)
        .groupBy("district")
        .agg(F.count(F.lit(1)).alias("hotspot_count"), F.round(F.avg("risk_score"), 2).alias("risk_score_avg"))
    )
    return totals.join(spots, "district", "left").select(
        "district",
        "total_incidents",
        F.coalesce("hotspot_count", F.lit(0)).cast("bigint").alias("hotspot_count"),
        F.coalesce("risk_score_avg", F.lit(0.0)).alias("risk_score_avg"),
    )
