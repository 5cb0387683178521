"""Bands, lookups and enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity points per incident type; any other type counts 1.
SEVERITY_POINTS = {
    "Homicide": 10,
    "Kidnapping": 8,
    "Robbery": 5,
    "Drug Offense": 4,
    "Assault": 3,
    "Burglary": 3,
    "Vehicle Theft": 2,
    "Fraud": 2,
    "Cyber Crime": 2,
    "Theft": 1,
}

# Category of each incident type.
TYPE_CATEGORIES = {
    "Theft": "Property Crime",
    "Burglary": "Property Crime",
    "Vehicle Theft": "Property Crime",
    "Robbery": "Violent Crime",
    "Assault": "Violent Crime",
    "Kidnapping": "Violent Crime",
    "Homicide": "Violent Crime",
    "Fraud": "White Collar Crime",
    "Cyber Crime": "White Collar Crime",
    "Drug Offense": "Narcotics",
}

# Accepted vocabularies.
INTAKE_TYPES = (
    "theft", "assault", "burglary", "robbery", "kidnapping",
    "homicide", "fraud", "vandalism", "domestic_violence", "other",
)
FLAG_TYPES = ("hotspot", "mo_match", "anomaly", "risk_score")
FLAG_STATUSES = ("pending", "acknowledged", "escalated", "dismissed")
DECISIONS = ("acknowledge", "escalate", "dismiss")
ROLES = ("constable", "sho", "sp", "analyst", "dgp")
INCIDENT_STATUSES = ("open", "under_review", "closed")

# The one flag-type vocabulary used here, from every spelling met in the inputs.
FLAG_TYPE_SPELLINGS = {
    "hotspot": "hotspot",
    "mo_link": "mo_match",
    "mo_match": "mo_match",
    "emerging_trend": "anomaly",
    "anomaly": "anomaly",
    "risk_score": "risk_score",
}

# Flag status after a decision, and the end status of the review route.
STATUS_AFTER = {"ACKNOWLEDGE": "ACKNOWLEDGED", "ESCALATE": "ESCALATED", "DISMISS": "DISMISSED"}
ROUTE_END = {
    "ACKNOWLEDGE": "CLOSED_ACKNOWLEDGED",
    "ESCALATE": "ESCALATED_PENDING_SP_REVIEW",
    "DISMISS": "CLOSED_DISMISSED",
}
ROUTE_ACTION = {
    "ACKNOWLEDGE": "ASSIGN_GROUND_PATROL",
    "ESCALATE": "SEND_MAIL_PUSH_NOTIF",
    "DISMISS": "LOG_AUDIT_FEEDBACK",
}


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value of a small fixed mapping, ``default`` when the key is absent."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def canonical(word: Column) -> Column:
    """A status, role, decision or type as the vocabularies above spell it."""
    return F.lower(F.trim(word))


def canonical_flag_type(word: Column) -> Column:
    """The one spelling of a flag type; an unknown one stays, in lower case."""
    return F.coalesce(lookup(FLAG_TYPE_SPELLINGS, canonical(word)), canonical(word))


def severity_points(crime_type: Column, points: dict[str, int] | None = None) -> Column:
    """Points of a type in any case; 1 for an unknown one."""
    return lookup({k.lower(): v for k, v in (points or SEVERITY_POINTS).items()}, canonical(crime_type), 1)


def type_category(crime_type: Column) -> Column:
    return lookup(TYPE_CATEGORIES, crime_type)


def z_severity(abs_z: Column, high: float = 4.0, critical: float = 5.0) -> Column:
    return F.when(abs_z >= critical, "Critical").when(abs_z >= high, "High").otherwise("Moderate")


def z_severity_rank(severity: Column) -> Column:
    return lookup({"Moderate": 1, "High": 2, "Critical": 3}, severity)


def trend_label(change: Column, threshold: float) -> Column:
    return (
        F.when(change > threshold, "Increasing").when(change < -threshold, "Decreasing").otherwise("Stable")
    )


def risk_band(score: Column, low: float = 25.0, moderate: float = 50.0, high: float = 75.0) -> Column:
    """Inclusive upper bounds: Low, Moderate, High, Critical."""
    return (
        F.when(score <= low, "Low").when(score <= moderate, "Moderate").when(score <= high, "High").otherwise("Critical")
    )


def dashboard_band(score: Column) -> Column:
    """Strict lower bounds used on the dashboard; not the same bands as ``risk_band``."""
    return (
        F.when(score > 75, "critical").when(score > 50, "high").when(score > 30, "medium").otherwise("low")
    )


def hotspot_severity(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").otherwise("MEDIUM")


def match_severity(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH").otherwise("MEDIUM")


def severity_order(severity: Column) -> Column:
    return lookup({"critical": 0, "high": 1, "medium": 2, "low": 3}, F.lower(severity), 4)
