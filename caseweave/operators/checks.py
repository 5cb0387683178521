"""Driver-side guards: columns, emptiness, parameters, and which optional inputs are usable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_COLUMNS = ("incident_id", "id", "case_id")
TYPE_COLUMNS = ("crime_type", "offense_type", "category")


class InputError(ValueError):
    """An input table cannot be used for the requested operator."""


def require_columns(df: DataFrame, columns: Sequence[str], label: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputError(f"{label} lacks required columns {missing}")
    return df


def require_rows(df: DataFrame, label: str = "input") -> DataFrame:
    """Runs a one-row action."""
    if df.isEmpty():
        raise InputError(f"{label} has no rows")
    return df


def require_all(checks: Sequence[tuple[bool, str]], what: str) -> None:
    """Raise one error naming every failed check."""
    failed = [message for ok, message in checks if not ok]
    if failed:
        raise ValueError(f"invalid {what}: " + "; ".join(failed))


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def id_column(df: DataFrame, keys: Sequence[str] = ()) -> Column:
    """Incident id as text. Without an id column the caller must name the key columns, because a
    Spark row has no stable index to fall back on."""
    name = first_present(df, ID_COLUMNS)
    if name:
        return F.col(name).cast("string")
    if not keys:
        raise InputError(f"none of the id columns {ID_COLUMNS} is present; name the key columns")
    require_columns(df, keys)
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def block_column(df: DataFrame) -> Column:
    """Incident type used for blocking, null read as UNKNOWN; one block when there is none."""
    name = first_present(df, TYPE_COLUMNS)
    if name is None:
        return F.lit("__ALL__")
    return F.coalesce(F.col(name).cast("string"), F.lit("UNKNOWN"))


def usable(df: DataFrame | None, columns: Sequence[str]) -> bool:
    """True when an optional table is present, has the columns, and has rows."""
    return df is not None and all(c in df.columns for c in columns) and not df.isEmpty()
