"""Numeric feature matrix: impute, drop, encode, standardize."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import InputError, id_column, require_columns
from .scale import exact_quantiles

# Text columns with more levels are no features unless ``max_levels`` says otherwise; ``dropped_columns`` lists them.
MAX_LEVELS = 50
# Distinct counts estimated above this multiple of the limit are certainly above it; those columns are not counted
# exactly, so no wide distinct aggregation is ever needed.
CERTAINLY_MANY = 4

# Fixed: identifiers and free text are never features.
NEVER_FEATURES = ("incident_id", "id", "case_id", "mo_text", "description", "narrative")
# Left out unless named: personal traits that must not drive a score.
SENSITIVE = (
    "victim_gender", "offender_gender", "victim_age", "offender_age", "socioeconomic_score",
    "religion", "religion_id", "caste", "caste_id",
)


def select_features(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = SENSITIVE) -> list[str]:
    """The named columns, or all but ids, free text and the excluded ones."""
    if columns is not None:
        if not columns:
            raise InputError("feature_columns is empty")
        require_columns(df, columns)
        return list(columns)
    chosen = [c for c in df.columns if c not in NEVER_FEATURES and c not in exclude]
    if not chosen:
        raise InputError("no usable feature columns remain; name them explicitly")
    return chosen


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))


def _number(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value)


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def feature_plan(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> tuple[list[dict], list[dict]]:
    """(numeric, categorical) encodings. Runs aggregations whose results have one row per column or
    a bounded number of rows per categorical column."""
    numeric = [c for c in columns if _is_numeric(df, c)]
    other = [c for c in columns if not _is_numeric(df, c)]
    numbers: list[dict] = []
    if numeric:
        stacked = df.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _number(c).alias("v")) for c in numeric])).alias("e")
        ).select("e.c", "e.v")
        medians = {r["c"]: r["m"] for r in exact_quantiles(stacked, "v", {"m": 0.5}, ["c"]).collect()}
        live = [c for c in numeric if medians.get(c) is not None]
        if live:
            filled = {c: F.coalesce(_number(c), F.lit(medians[c])) for c in live}
            stats = df.agg(
                *[F.min(v).alias(f"{c}|lo") for c, v in filled.items()], *[F.max(v).alias(f"{c}|hi") for c, v in filled.items()],
                *[F.avg(v).alias(f"{c}|mean") for c, v in filled.items()], *[F.stddev_pop(v).alias(f"{c}|sd") for c, v in filled.items()],
            ).first()
            numbers = [
                {"column": c, "median": medians[c], "mean": stats[f"{c}|mean"], "sd": stats[f"{c}|sd"]}
                for c in live
                if stats[f"{c}|lo"] != stats[f"{c}|hi"]
            ]
    categories: list[dict] = []
    if other:
        sketch = df.agg(*[F.approx_count_distinct(_text(c), 0.02).alias(c) for c in other]).first()
        few = [c for c in other if 0 < sketch[c] <= CERTAINLY_MANY * max_levels]
        if few:
            levels = (
                df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _text(c).alias("v")) for c in few])).alias("e"))
                .groupBy("e.c", "e.v")
                .agg(F.count(F.lit(1)).alias("n"))
                .collect()
            )
            for c in few:
                seen = {r["v"] for r in levels if r["c"] == c}
                known = sorted(v for v in seen if v is not None)
                encoded = sorted(set(known) | ({"missing"} if None in seen else set()))
                if len(known) <= max_levels and len(encoded) > 1:
                    categories.append({"column": c, "levels": encoded})
    if not numbers and not categories:
        raise InputError("no usable features remain: all columns are empty, constant or have too many levels")
    return numbers, categories


def feature_columns(numbers: list[dict], categories: list[dict]) -> list[tuple[str, Column]]:
    """Standardized numbers first, then one 0/1 column per level."""
    out = [
        (p["column"], (F.coalesce(_number(p["column"]), F.lit(p["median"])) - F.lit(p["mean"])) / F.lit(p["sd"]))
        for p in numbers
    ]
    for p in categories:
        for level in p["levels"]:
            hit = F.coalesce(_text(p["column"]), F.lit("missing")) == F.lit(level)
            out.append((f"{p['column']}_{level}", F.when(hit, 1.0).otherwise(0.0)))
    return out


def dropped_columns(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = SENSITIVE, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(column, reason) of the chosen columns that are no features."""
    chosen = select_features(df, columns, exclude)
    numbers, categories = feature_plan(df, chosen, max_levels)
    used = {p["column"] for p in [*numbers, *categories]}
    left = [c for c in chosen if c not in used]
    levels = df.agg(F.lit(0).alias("|"), *[F.approx_count_distinct(_text(c), 0.02).alias(c) for c in left]).first()
    reason = lambda c: "more than " + str(max_levels) + " levels" if not _is_numeric(df, c) and levels[c] > 1 else "empty or constant"
    return df.sparkSession.createDataFrame([(c, reason(c)) for c in left], "column string, reason string")


def feature_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), exclude: Sequence[str] = SENSITIVE, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """(incident_id, features array<double>) and the feature names in the column's metadata."""
    encoded = feature_columns(*feature_plan(df, select_features(df, columns, exclude), max_levels))
    return df.select(
        id_column(df, keys).alias("incident_id"),
        F.array(*[v for _, v in encoded]).alias("features", metadata={"names": [n for n, _ in encoded]}),
    )


def feature_names(matrix: DataFrame) -> list[str]:
    return list(matrix.schema["features"].metadata["names"])
