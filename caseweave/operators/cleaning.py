"""Row cleaning ahead of the spatial and temporal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import parse_double, parse_timestamp
from .checks import require_columns

SPATIAL_COLUMNS = ("incident_id", "crime_type", "district", "latitude", "longitude", "occurrence_datetime")
TREND_COLUMNS = ("incident_id", "crime_type", "district", "occurrence_datetime")


def _typed_time(df: DataFrame) -> DataFrame:
    if df.schema["occurrence_datetime"].dataType.typeName() in ("timestamp", "timestamp_ntz"):
        return df
    return df.withColumn("occurrence_datetime", parse_timestamp(F.col("occurrence_datetime")))


def clean_coordinates(df: DataFrame) -> DataFrame:
    """Keep rows with numeric in-range coordinates, a valid time and an id (bounds inclusive)."""
    require_columns(df, SPATIAL_COLUMNS)
    typed = _typed_time(
        df.withColumns({"latitude": parse_double(F.col("latitude")), "longitude": parse_double(F.col("longitude"))})
    )
    return typed.where(
        F.col("latitude").between(-90, 90)
        & F.col("longitude").between(-180, 180)
        & F.col("occurrence_datetime").isNotNull()
        & F.col("incident_id").isNotNull()
    )


def clean_times(df: DataFrame) -> DataFrame:
    """Drop rows with a null in the four trend columns and add ``occurrence_date``."""
    require_columns(df, TREND_COLUMNS)
    return (
        _typed_time(df).dropna(subset=list(TREND_COLUMNS)).withColumn("occurrence_date", F.to_date("occurrence_datetime"))
    )


def without_noise(assignments: DataFrame) -> DataFrame:
    return assignments.where(F.col("cluster_id") != -1)
