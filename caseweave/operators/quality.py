"""Row rules that collect every violation, referential and uniqueness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.timeparts import parse_timestamp

Rule = tuple[str, Column, str]  # field, condition that must hold, message


def violations(df: DataFrame, rules: Sequence[Rule], name: str = "field_errors") -> DataFrame:
    """Add an array of (field, message) for every broken rule; a null condition counts as broken."""
    checked = [
        F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(m).alias("message")))
        for f, ok, m in rules
    ]
    return df.withColumn(name, F.array_compact(F.array(*checked)))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows without violations, rows with them and the list of violations)."""
    checked = violations(df, rules)
    bad = F.size("field_errors") > 0
    return checked.where(~bad).drop("field_errors"), checked.where(bad)


def not_blank(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def one_of(c: Column, values: Sequence[str]) -> Column:
    return c.isin(*values)


def intake_rules() -> list[Rule]:
    """Rules of the intake payload. List-typed fields are enforced by the declared schema."""
    allowed = ", ".join(labels.INTAKE_TYPES)
    return [
        ("fir_number", not_blank(F.col("fir_number")), "required, non-empty string"),
        ("incident_type", one_of(F.col("incident_type"), labels.INTAKE_TYPES), f"must be one of: {allowed}"),
        ("reported_at", parse_timestamp(F.col("reported_at")).isNotNull(), "required, valid ISO date"),
        ("occurred_at", parse_timestamp(F.col("occurred_at")).isNotNull(), "required, valid ISO date"),
        ("created_by", not_blank(F.col("created_by")), "required"),
        ("location", F.col("location").isNotNull(), "required object"),
        (
            "location.latitude/longitude",
            F.col("location").isNull() | valid_point(F.col("location.latitude"), F.col("location.longitude")),
            "must be valid coordinates",
        ),
        (
            "location.district_id",
            F.col("location").isNull() | F.col("location.district_id").try_cast("bigint").isNotNull(),
            "required integer",
        ),
    ]


def flag_type_rule(c: str = "flag_type") -> Rule:
    return (c, one_of(labels.canonical_flag_type(F.col(c)), labels.FLAG_TYPES), f"must be one of: {', '.join(labels.FLAG_TYPES)}")


def decision_rule(c: str = "decision") -> Rule:
    return (c, one_of(F.lower(F.col(c)), labels.DECISIONS), f"must be one of: {', '.join(labels.DECISIONS)}")


def enum_rules() -> dict[str, Rule]:
    """Column checks of the stored tables, by ``table.column``."""
    return {
        "users.role": ("role", one_of(F.col("role"), labels.ROLES), "unknown role"),
        "incidents.status": ("status", one_of(labels.canonical(F.col("status")), labels.INCIDENT_STATUSES), "unknown status"),
        "flags.status": ("status", one_of(labels.canonical(F.col("status")), labels.FLAG_STATUSES), "unknown status"),
        "flags.flag_type": flag_type_rule(),
        "review_decisions.decision": decision_rule(),
    }


# Child column -> parent column for every foreign key of the stored tables.
FOREIGN_KEYS = {
    "locations.district_id": "districts.district_id",
    "users.district_id": "districts.district_id",
    "incidents.location_id": "locations.location_id",
    "incidents.created_by": "users.user_id",
    "incident_offenders.incident_id": "incidents.incident_id",
    "incident_offenders.offender_id": "offenders.offender_id",
    "incident_victims.incident_id": "incidents.incident_id",
    "incident_victims.victim_id": "victims.victim_id",
    "flags.incident_id": "incidents.incident_id",
    "flags.assigned_district_id": "districts.district_id",
    "review_decisions.flag_id": "flags.flag_id",
    "review_decisions.decided_by": "users.user_id",
    "action_outcomes.decision_id": "review_decisions.decision_id",
    "action_outcomes.recorded_by": "users.user_id",
}


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str) -> DataFrame:
    """Key values of ``child`` that ``parent`` lacks, with their row count.

    The child is reduced to one row per key value before the join, so a hot key costs nothing.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    known = parent.select(F.col(parent_column).cast("string").alias("key")).distinct()
    return keys.join(known, "key", "left_anti").select(F.lit(name).alias("constraint"), "key", "rows")


def foreign_key_report(tables: dict[str, DataFrame], keys: dict[str, str] | None = None) -> DataFrame:
    """One row per (constraint, missing key) over all foreign keys whose two tables are given."""
    parts = []
    for child, parent in (keys or FOREIGN_KEYS).items():
        (ct, cc), (pt, pc) = child.split("."), parent.split(".")
        if ct in tables and pt in tables:
            parts.append(orphan_keys(tables[ct], cc, tables[pt], pc, child))
    if not parts:
        raise ValueError("no foreign key has both of its tables among the inputs")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
