"""Scans and schema mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import InputError, require_columns
from . import schemas


def read_csv(spark: SparkSession, path: str, schema: str = schemas.INCIDENTS, null_value: str = "None") -> DataFrame:
    """Header CSV with a declared schema. ``null_value`` is read as null; pass "" to keep the text."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null_value).option("enforceSchema", False).csv(path)


def read_required_csv(spark: SparkSession, path: str, label: str, schema: str) -> DataFrame:
    """As ``read_csv``; a missing, unreadable or empty file is an error."""
    try:
        df = read_csv(spark, path, schema)
        empty = df.isEmpty()
    except Exception as cause:
        raise InputError(f"{label}: cannot read {path}") from cause
    if empty:
        raise InputError(f"{label}: {path} has no rows")
    return df


def read_optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """None when the file is missing, unreadable or empty."""
    try:
        df = read_csv(spark, path, schema)
        return None if df.isEmpty() else df
    except Exception:
        return None


def read_json_records(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """A JSON array of records; with ``lines`` one record per line, as ``write_json`` writes them, which also lets files be split."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_case_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_json_records(spark, path, schemas.CASE_DOCUMENT)


def flatten_cases(documents: DataFrame) -> DataFrame:
    """One flat row per case document, in the incident table's names."""
    require_columns(documents, ["CaseMasterID", "Accused", "ActSectionAssociation"])
    return documents.select(
        F.col("CaseMasterID").cast("string").alias("incident_id"),
        F.col("CaseNo").alias("case_no"),
        F.col("DistrictName").alias("district"),
        F.col("PoliceStationName").alias("police_station"),
        F.col("IncidentFromDate").alias("occurrence_datetime"),
        F.col("InfoReceivedPSDate").alias("reported_datetime"),
        "latitude",
        "longitude",
        F.col("BriefFacts").alias("narrative"),
        "mo_tags",
        F.col("Accused.AccusedMasterID").cast("string").alias("offender_id"),
        F.col("Accused.AccusedName").alias("offender_name"),
        F.col("Accused.prior_record_flag").alias("prior_record_flag"),
        F.col("Accused.prior_cases_count").alias("prior_cases_count"),
        F.col("Victim.VictimMasterID").cast("string").alias("victim_id"),
    )


def case_sections(documents: DataFrame) -> DataFrame:
    """One row per (case, act section)."""
    return documents.select(
        F.col("CaseMasterID").cast("string").alias("incident_id"), F.explode("ActSectionAssociation").alias("s")
    ).select("incident_id", "s.*")


# Live incident columns and their names in the incident table.
LIVE_COLUMNS = {
    "fir_number": "incident_id",
    "case_type": "crime_type",
    "district_id": "district",
    "station_id": "police_station",
}


def map_live_incidents(live: DataFrame, default_time: str = "2026-01-01 00:00:00") -> DataFrame:
    """Rename live columns, take the event time from ``created_at`` when it is absent, and fill
    missing required columns with UNKNOWN."""
    df = live
    if "occurrence_datetime" not in df.columns:
        source = F.col("created_at") if "created_at" in df.columns else F.lit(default_time)
        df = df.withColumn("occurrence_datetime", F.try_to_timestamp(source.cast("string")))
    df = df.withColumnsRenamed(LIVE_COLUMNS)
    for name in ("incident_id", "crime_type", "district"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("UNKNOWN"))
    return df
