"""Incremental daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import read_all, run_available, write_batch

CELL = ("date", "district", "crime_type")


def partial_counts(incidents: DataFrame) -> DataFrame:
    """Counts per (date, district, crime_type) of the given incidents."""
    day = F.to_date("occurrence_datetime").alias("date")
    return incidents.groupBy(day, "district", "crime_type").agg(F.count(F.lit(1)).alias("daily_incidents"))


def run_daily_counts(incidents: DataFrame, folder: str, checkpoint: str) -> None:
    """Store each batch's own counts below ``folder/daily_counts``. Days never close, so no row comes too late."""
    writer = incidents.writeStream.foreachBatch(lambda df, batch: write_batch(partial_counts(df), folder, "daily_counts", batch))
    run_available(writer, checkpoint)


def current_counts(spark, folder: str) -> DataFrame:
    """The sum of the batches' counts of each cell."""
    return read_all(spark, folder, "daily_counts").groupBy(*CELL).agg(F.sum("daily_incidents").alias("daily_incidents"))
