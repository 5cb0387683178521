"""Sinks. Spark's commit protocol makes each write all-or-nothing per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")  # Spark's own drops microseconds
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def as_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text; dates are ISO, nulls are kept, NaN becomes null."""
    plain = df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )
    return plain.select(F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> str:
    as_json_lines(df).write.mode("overwrite").text(path)
    return path


def write_outputs(tables: dict[str, DataFrame | None], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each present table under its name."""
    return {n: write_table(df, f"{folder.rstrip('/')}/{n}", fmt) for n, df in tables.items() if df is not None}
