"""Named selections, projections and orders used by the views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import natural_order

# Every spelling of a status in which a case is still worked on.
OPEN_STATUSES = ("OPEN", "UNDER_INVESTIGATION", "UNDER_REVIEW")

# What each role may use.
ROLE_FEATURES = {
    "constable": ("crime_map", "incident_submission"),
    "sho": ("crime_map", "risk_forecast", "alert_review", "incident_submission", "full_incident_list"),
    "sp": ("crime_map", "network_analysis", "risk_forecast", "alert_review", "full_incident_list"),
    "analyst": ("crime_map", "network_analysis", "risk_forecast", "alert_review", "full_incident_list"),
    "dgp": ("crime_map", "risk_forecast", "alert_review", "plain_language_brief"),
}
FEATURES = (
    "crime_map", "network_analysis", "risk_forecast", "alert_review",
    "plain_language_brief", "incident_submission", "full_incident_list",
)
# Personal columns withheld from lower tiers.
VICTIM_IDENTITY = ("victim_id", "victim_name", "contact_info", "contact_phone", "contact_address")
WITHHELD = {"constable": VICTIM_IDENTITY, "sho": (), "sp": (), "analyst": VICTIM_IDENTITY, "dgp": VICTIM_IDENTITY}


def role_matrix(spark) -> DataFrame:
    """Role x capability booleans (five fixed rows)."""
    rows = [(r, *[f in have for f in FEATURES]) for r, have in ROLE_FEATURES.items()]
    return spark.createDataFrame(rows, "role string, " + ", ".join(f"{f} boolean" for f in FEATURES))


def for_role(df: DataFrame, role: str) -> DataFrame:
    """Drop the columns withheld from a role."""
    return df.drop(*[c for c in WITHHELD[role.lower()] if c in df.columns])


def on_map(df: DataFrame, district: str | None = None, severities: Sequence[str] = (), categories: Sequence[str] = ()) -> DataFrame:
    """District equality, severity and category lists; an empty list means all."""
    out = df if district is None else df.where(F.col("district") == district)
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    return out.where(F.col("category").isin(*categories)) if categories else out


def recent(df: DataFrame, as_of: Column, days: int = 7, stamp: str = "occurrence_datetime") -> DataFrame:
    return df.where(F.col(stamp) >= as_of - F.make_dt_interval(days=F.lit(days)))


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters by column, compared in the column's own type."""
    out = df
    for column, value in wanted.items():
        out = out.where(F.col(column) == F.lit(value).cast(df.schema[column].dataType))
    return out


def in_jurisdiction(flags: DataFrame, station: str) -> DataFrame:
    return flags.where((F.col("jurisdiction_id") == station) | (F.col("target_id") == station))


def serious_or_escalated(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("severity").isin("HIGH", "CRITICAL") | (F.col("status") == "ESCALATED"))


def open_backlog(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.upper("status").isin(*OPEN_STATUSES))


def repeat_people(people: DataFrame) -> DataFrame:
    return people.where("prior_record_flag").select("offender_id", "name", "risk_tier", "vehicle_no", "prior_cases_count")


def surfaced_anomalies(flags: DataFrame) -> DataFrame:
    return flags.where(F.col("flag_type").isin("ANOMALY", "EMERGING_TREND"))


def relation_edges(edges: DataFrame, relation: str = "SIMILAR_MO") -> DataFrame:
    return edges.where(F.col("relation") == relation)


def incident_summary(incidents: DataFrame) -> DataFrame:
    """Flat summary of incidents with a nested ``location``."""
    return incidents.select(
        "incident_id", "fir_number", "title", "category", "severity", "status",
        F.col("location.district").alias("district"),
        F.col("location.police_station").alias("police_station"),
        F.col("location.coordinates").alias("coordinates"),
        "occurrence_datetime",
    )


def table_order(df: DataFrame, column: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Numeric-aware text order of one column, as in a generic sortable table."""
    keys = [k.desc() if descending else k.asc() for k in natural_order(F.col(column))]
    ordered = df.orderBy(*keys)
    return ordered if limit is None else ordered.limit(limit)
