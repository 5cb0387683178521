"""Registered queries: result tables in their surveyed orders, every row with its position."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import dbscan, forest, hotspots, risk, similarity, trend
from ...operators.scale import materialize, shared_folder
from ...sources.ordered import ORDERS, order_of, read_ordered, write_ordered
from .. import inputs
from . import places, scores, texts, trends
from .common import FLAGS, shaped, with_


def in_order(df, table):
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/caseweave/{uuid.uuid4().hex}"
    return shaped(read_ordered(df.sparkSession, write_ordered(df, folder, order_of(table))))


def _positioned(sql: str, table: str, columns: str = "*", order: str | None = None) -> str:
    """The rows of ``sql`` numbered in the order of ``table``."""
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order or ORDERS[table]}) AS position FROM ({sql}) rows_"


def _order_trends(spark, d):
    summary = materialize(trend.trend_summary(trend.daily_grid(trend.daily_counts(inputs.order_incidents(spark, d)))))
    return summary, trend.anomalies(summary)


def ordered_clusters(spark, d):
    stats = hotspots.cluster_statistics(materialize(dbscan.assign_clusters(inputs.geo_incidents(spark, d))))
    return in_order(stats.select("cluster_id", "number_of_incidents"), "cluster_stats")


def ordered_assignments(spark, d):
    found = dbscan.assignments(dbscan.assign_clusters(inputs.geo_incidents(spark, d)))
    return in_order(found.select("incident_id", "cluster_id"), "cluster_assignments")


def ordered_grid(spark, d):
    grid = trend.daily_grid(trend.daily_counts(inputs.event_incidents(spark, d)))
    return in_order(grid.select("date", "district", "crime_type", "daily_incidents"), "trend_summary")


def ordered_anomalies(spark, d):
    return in_order(_order_trends(spark, d)[1].select("date", "district", "crime_type", "z_score"), "anomalies")


def ordered_spikes(spark, d):
    found = trend.spike_events(_order_trends(spark, d)[1])
    return in_order(found.select("district", "crime_type", "spike_start", "peak_incident_count"), "spike_events")


def ordered_statistics(spark, d):
    found = trend.series_statistics(*_order_trends(spark, d))
    return in_order(found.select("district", "crime_type", "total_incidents"), "statistics")


def ordered_ranking(spark, d):
    return in_order(trend.district_ranking(*_order_trends(spark, d)).select("district", "rank_by_incidents"), "district_ranking")


def ordered_risk(spark, d):
    """Districts by risk with the levels of the scores and the bands of the district cards."""
    found, _ = risk.risk_scores(*scores._risk_inputs(spark, d))
    band = F.when(F.col("risk_score") > 75, "critical").when(F.col("risk_score") > 50, "high").when(F.col("risk_score") > 30, "medium").otherwise("low")
    return in_order(found.select("district", "risk_score", "risk_level", band.alias("band")), "risk_scores")


def ordered_importance(spark, d):
    """Weights of the score, renormalized because no incident says who offends again, with the points that each feature brings on average."""
    geo, *rest = scores._risk_inputs(spark, d)
    incidents = geo.drop("repeat_offender")
    found, weights = risk.risk_scores(incidents, *rest)
    points = F.array(*[
        F.struct(F.lit(r["feature"]).alias("feature"), (F.col(f"{r['feature']}_normalized") * F.lit(_ACTIVE[r["feature"]]) * 100).alias("points"))
        for r in weights.collect() if r["normalized_weight"] > 0
    ])
    means = found.select(F.explode(points).alias("p")).groupBy("p.feature").agg(F.avg("p.points").alias("mean_points"))
    return in_order(weights.join(means, "feature", "left").withColumn("mean_points", F.coalesce("mean_points", F.lit(0.0))), "risk_feature_importance")


def ordered_outliers(spark, d):
    """Outlier scores in ascending order: how many rows, and how many stand before a lower score or out of step."""
    found = forest.isolation_scores(scores._gappy_orders(spark, d), feature_columns=scores._MATRIX_COLUMNS).select("incident_id", "anomaly_score")
    folder = f"{shared_folder(spark).rstrip('/')}/caseweave/{uuid.uuid4().hex}"
    rows = materialize(read_ordered(spark, write_ordered(found, folder, order_of("incident_anomalies"))))
    later = rows.select((F.col("position") - 1).alias("position"), F.col("anomaly_score").alias("next"))
    joined = rows.join(later, "position", "left")
    return shaped(joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("next") < F.col("anomaly_score")).alias("descents"),
        F.count_if(F.col("next").isNull()).alias("last_rows"), F.max("position").alias("last_position"),
    ))


def ordered_matches(spark, d):
    found = similarity.cosine_top_k(inputs.part_cases(spark, d)).withColumn("similarity_score", F.round("similarity_score", 6))
    return in_order(found, "similar_incidents")


def ordered_flags(spark, d):
    return in_order(inputs.event_flags(spark, d).select("flag_id", "created_at"), "flags")


def ordered_hotspots(spark, d):
    return in_order(hotspots.grid_hotspots(inputs.geo_incidents(spark, d)).select("hotspot_id", "risk_score"), "hotspots")


def _from(queries: dict, name: str) -> str:
    return queries[name][1]


#: The weights without the share of repeat offenders.
_ACTIVE = {n: w / (1 - risk.WEIGHTS["repeat_offender_percentage"]) for n, w in risk.WEIGHTS.items() if n != "repeat_offender_percentage"}

QUERIES = {
    "ordered_clusters": (ordered_clusters, _positioned(_from(places.QUERIES, "cluster_stats"), "cluster_stats", "cluster_id, number_of_incidents")),
    "ordered_assignments": (ordered_assignments, _positioned(_from(places.QUERIES, "dbscan_assignments"), "cluster_assignments", "incident_id, cluster_id")),
    "ordered_grid": (ordered_grid, _positioned(_from(trends.QUERIES, "daily_grid"), "trend_summary")),
    "ordered_anomalies": (ordered_anomalies, _positioned(_from(trends.QUERIES, "trend_anomalies"), "anomalies", "date, district, crime_type, z_score")),
    "ordered_spikes": (ordered_spikes, _positioned(_from(trends.QUERIES, "spike_events"), "spike_events", "district, crime_type, spike_start, peak_incident_count")),
    "ordered_statistics": (ordered_statistics, _positioned(_from(trends.QUERIES, "series_statistics"), "statistics", "district, crime_type, total_incidents")),
    "ordered_ranking": (ordered_ranking, _positioned(_from(trends.QUERIES, "district_ranking"), "district_ranking", "district, rank_by_incidents")),
    "ordered_risk": (
        ordered_risk,
        _positioned(_from(scores.QUERIES, "risk_scores"), "risk_scores", """district, risk_score, risk_level,
          CASE WHEN risk_score > 75 THEN 'critical' WHEN risk_score > 50 THEN 'high' WHEN risk_score > 30 THEN 'medium' ELSE 'low' END AS band"""),
    ),
    "ordered_importance": (
        ordered_importance,
        with_(scores._RISK + scores._NORMAL + ", w AS (" + " UNION ALL ".join(
            f"SELECT '{n}' AS feature, {round(w, 4)}::DOUBLE AS weight, {round(_ACTIVE.get(n, 0.0), 4)}::DOUBLE AS normalized_weight, "
            + (f"(SELECT round(avg({n}_normalized * {_ACTIVE[n]}::DOUBLE * 100), 6) FROM normal)" if n in _ACTIVE else "0.0::DOUBLE") + " AS mean_points"
            for n, w in risk.WEIGHTS.items()
        ) + ")", _positioned("SELECT * FROM w", "risk_feature_importance"), True),
    ),
    "ordered_outliers": (
        ordered_outliers,
        """SELECT count(*) AS rows, CAST(0 AS BIGINT) AS descents, CAST(1 AS BIGINT) AS last_rows, count(*) AS last_position
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "ordered_matches": (ordered_matches, _positioned(_from(texts.QUERIES, "cosine_topk"), "similar_incidents")),
    "ordered_flags": (ordered_flags, with_(FLAGS, _positioned("SELECT flag_id, created_at FROM flags", "flags"))),
    "ordered_hotspots": (ordered_hotspots, _positioned(_from(places.QUERIES, "grid_hotspots"), "hotspots", "hotspot_id, risk_score")),
}
