"""District risk: features from the upstream tables, scaling, weighted score, contributors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import bool_flag, clip, min_max, ratio_or
from .checks import InputError, require_all, require_columns, require_rows, usable

# Default weights; they add up to 1.
WEIGHTS = {
    "total_incidents": 0.25,
    "average_hotspot_severity": 0.20,
    "trend_anomalies": 0.15,
    "crime_diversity": 0.10,
    "average_trend_strength": 0.10,
    "average_z_score": 0.10,
    "average_hotspot_density": 0.05,
    "repeat_offender_percentage": 0.05,
}
REQUIRED = {
    "incidents": ["incident_id", "district", "crime_type"],
    "cluster_stats": ["cluster_id", "district", "severity_score", "density", "cluster_radius_metres", "number_of_incidents"],
    "trend_stats": ["district", "crime_type", "total_incidents", "trend_direction"],
    "anomalies": ["district", "crime_type", "z_score", "severity"],
}
FEATURES = [
    "total_incidents", "crime_diversity", "dominant_trend_direction", "number_of_hotspots",
    "average_hotspot_severity", "average_hotspot_density", "average_hotspot_radius", "trend_anomalies",
    "average_z_score", "average_trend_strength", "number_of_spike_events", "repeat_offender_percentage",
    "crime_rate", "hotspot_coverage_ratio",
]


def check_weights(weights: dict[str, float]) -> None:
    unknown = sorted(set(weights) - set(WEIGHTS))
    negative = sorted(k for k, v in weights.items() if v < 0)
    require_all(
        [
            (not unknown, f"unknown features {unknown}"),
            (not negative, f"negative weights for {negative}"),
            (sum(weights.values()) > 0, "at least one weight must be positive"),
        ],
        "risk weights",
    )


def check_thresholds(low: float, moderate: float, high: float) -> None:
    require_all([(0 < low < moderate < high < 100, "need 0 < low < moderate < high < 100")], "risk thresholds")


def availability(incidents, cluster_stats, trend_stats, anomalies, trend_summary=None, spike_events=None) -> dict[str, bool]:
    """Check the required tables and say which optional inputs can be used. Clusters and anomalies
    may be empty, but must have their columns."""
    given = {"incidents": incidents, "cluster_stats": cluster_stats, "trend_stats": trend_stats, "anomalies": anomalies}
    for name, df in given.items():
        require_columns(df, REQUIRED[name], name)
    require_rows(incidents, "incidents")
    require_rows(trend_stats, "trend_stats")
    return {
        "population_density": "population_density" in incidents.columns,
        "repeat_offender": "repeat_offender" in incidents.columns,
        "trend_summary": usable(trend_summary, ["district", "trend_strength_pct"]),
        "spike_events": usable(spike_events, ["district"]),
    }


def merged(tables: list[DataFrame]) -> DataFrame:
    """Tables of one row per district side by side, with a row for every district of any of them. One small aggregation, no joins."""
    keyed = [t.withColumn("district", F.col("district").cast("string")).where(F.col("district").isNotNull()) for t in tables]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed)
    return stacked.groupBy("district").agg(*[F.max(c).alias(c) for c in stacked.columns if c != "district"])


def district_features(incidents, cluster_stats, trend_stats, anomalies, trend_summary=None, spike_events=None, available: dict[str, bool] | None = None) -> DataFrame:
    """One row per district with the raw features; a source without the district counts 0."""
    ok = available or availability(incidents, cluster_stats, trend_stats, anomalies, trend_summary, spike_events)
    per_trend = trend_stats.groupBy("district").agg(
        F.sum("total_incidents").alias("total_incidents"),
        F.count_distinct("crime_type").alias("crime_diversity"),
        F.mode("trend_direction", True).alias("dominant_trend_direction"),
    )
    per_cluster = cluster_stats.groupBy("district").agg(
        F.count("cluster_id").alias("number_of_hotspots"),
        F.avg("severity_score").alias("average_hotspot_severity"),
        F.avg("density").alias("average_hotspot_density"),
        F.avg("cluster_radius_metres").alias("average_hotspot_radius"),
        F.sum("number_of_incidents").alias("_clustered"),
    )
    per_anomaly = anomalies.groupBy("district").agg(
        F.count("z_score").alias("trend_anomalies"), F.avg(F.abs("z_score")).alias("average_z_score")
    )
    tables = [per_trend, per_cluster, per_anomaly]
    if ok["trend_summary"]:
        tables.append(trend_summary.groupBy("district").agg(F.avg("trend_strength_pct").alias("average_trend_strength")))
    if ok["spike_events"]:
        tables.append(spike_events.groupBy("district").agg(F.count(F.lit(1)).alias("number_of_spike_events")))
    extra = [F.count(F.lit(1)).alias("_incidents")]
    if ok["repeat_offender"]:
        extra.append((F.avg(bool_flag(F.col("repeat_offender"))) * 100.0).alias("repeat_offender_percentage"))
    if ok["population_density"]:
        extra.append(F.avg("population_density").alias("_density"))
    tables.append(incidents.groupBy("district").agg(*extra))
    joined = merged(tables)

    def number(name: str):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in joined.columns else F.lit(0.0)

    plain = [f for f in FEATURES if f not in ("dominant_trend_direction", "crime_rate", "hotspot_coverage_ratio")]
    filled = joined.select(
        "district",
        *[number(f).alias(f) for f in plain],
        F.coalesce("dominant_trend_direction", F.lit("Stable")).alias("dominant_trend_direction"),
        number("_clustered").alias("_clustered"),
        (F.col("_density") if ok["population_density"] else F.lit(0.0)).alias("_density"),
    )
    return filled.withColumns(
        {
            "crime_rate": ratio_or(F.col("total_incidents"), F.nullif(F.col("_density"), F.lit(0.0))),
            "hotspot_coverage_ratio": ratio_or(F.col("_clustered"), F.nullif(F.col("total_incidents"), F.lit(0.0))),
        }
    ).select("district", *FEATURES)


def active_weights(weights: dict[str, float], available: dict[str, bool]) -> dict[str, float]:
    """Positive weights of usable features, rescaled to add up to 1."""
    missing = set()
    if not available["trend_summary"]:
        missing.add("average_trend_strength")
    if not available["repeat_offender"]:
        missing.add("repeat_offender_percentage")
    kept = {k: v for k, v in weights.items() if v > 0 and k not in missing}
    total = sum(kept.values())
    if total <= 0:
        raise InputError("no usable feature weight remains")
    return {k: v / total for k, v in kept.items()}


def normalized(features: DataFrame, names: list[str]) -> DataFrame:
    """Min-max columns ``<name>_normalized`` over all districts."""
    bounds = features.agg(
        F.struct(*[F.min(n).alias(f"{n}_lo") for n in names], *[F.max(n).alias(f"{n}_hi") for n in names]).alias("b")
    ).scalar()
    scaled = features.withColumn("_b", bounds)
    return scaled.withColumns(
        {f"{n}_normalized": min_max(F.col(n), F.col(f"_b.{n}_lo"), F.col(f"_b.{n}_hi")) for n in names}
    ).drop("_b")


def scored(scaled: DataFrame, weights: dict[str, float], low: float = 25.0, moderate: float = 50.0, high: float = 75.0) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(f"{n}_normalized") * F.lit(w) for n, w in weights.items()])
    return scaled.withColumn("risk_score", F.round(clip(total * 100.0, 0.0, 100.0), 2)).withColumn(
        "risk_level", labels.risk_band(F.col("risk_score"), low, moderate, high)
    )


def importance(spark: SparkSession, configured: dict[str, float], active: dict[str, float]) -> DataFrame:
    rows = [(k, round(v, 4), round(active.get(k, 0.0), 4)) for k, v in configured.items()]
    return spark.createDataFrame(rows, "feature string, weight double, normalized_weight double")


def contributors(scaled: DataFrame, weights: dict[str, float], top: int = 3) -> DataFrame:
    """The features that add most to each district's score (exact, as the score is linear)."""
    parts = F.array(
        *[F.struct((F.col(f"{n}_normalized") * F.lit(w) * 100.0).alias("points"), F.lit(n).alias("feature")) for n, w in weights.items()]
    )
    rank = F.row_number().over(Window.partitionBy("district").orderBy(F.col("points").desc(), "feature"))
    return (
        scaled.select("district", F.explode(parts).alias("p"))
        .select("district", F.round("p.points", 6).alias("points"), "p.feature")
        .withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= top)
    )


def risk_scores(
    incidents: DataFrame,
    cluster_stats: DataFrame,
    trend_stats: DataFrame,
    anomalies: DataFrame,
    trend_summary: DataFrame | None = None,
    spike_events: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    low: float = 25.0,
    moderate: float = 50.0,
    high: float = 75.0,
) -> tuple[DataFrame, DataFrame]:
    """(district scores, feature importance). A partial ``weights`` sets the other features to 0."""
    given = dict(WEIGHTS) if weights is None else dict(weights)
    check_weights(given)
    check_thresholds(low, moderate, high)
    configured = {name: given.get(name, 0.0) for name in WEIGHTS}
    ok = availability(incidents, cluster_stats, trend_stats, anomalies, trend_summary, spike_events)
    active = active_weights(configured, ok)
    features = district_features(incidents, cluster_stats, trend_stats, anomalies, trend_summary, spike_events, ok)
    result = scored(normalized(features, list(active)), active, low, moderate, high)
    return result, importance(incidents.sparkSession, configured, active)
