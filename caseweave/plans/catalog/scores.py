"""Registered queries: feature matrix, outliers, district risk, tier-model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import labels, timeparts
from ...operators import dbscan, features, forest, hotspots, risk, risk_model, trend, views
from ...operators.scale import materialize
from .. import inputs
from .common import CLUSTER_STATS, EVENTS, GEO, METRES, ORDERS, TREND, shaped, with_

_MATRIX_COLUMNS = ["property_loss", "repeat_offender", "status", "segment", "crime_type"]


def _gappy_orders(spark, d):
    """Order incidents with some losses and statuses missing."""
    i = F.col("incident_id")
    return inputs.order_incidents(spark, d).withColumns(
        {"property_loss": F.when(i % 50 != 0, F.col("property_loss")), "status": F.when(i % 41 != 0, F.col("status"))}
    )


def feature_matrix(spark, d):
    m = features.feature_matrix(_gappy_orders(spark, d), _MATRIX_COLUMNS)
    names = features.feature_names(m)
    return shaped(m.select("incident_id", *[F.col("features")[i].alias(n.lower().replace("-", "_").replace(" ", "_")) for i, n in enumerate(names)]))


def isolation_scores(spark, d):
    return shaped(forest.isolation_scores(_gappy_orders(spark, d), feature_columns=_MATRIX_COLUMNS))


def _clustered(spark, d):
    """(incidents of the risk scores, the same with their clusters)."""
    geo = inputs.geo_incidents(spark, d).withColumns({"repeat_offender": F.col("k") % 3 == 0, "population_density": F.col("k")})
    return geo, materialize(dbscan.assign_clusters(geo))


def _risk_inputs(spark, d, clustered=None):
    """``clustered`` is what ``_clustered`` gave, if the caller needs it too."""
    geo, assigned = clustered or _clustered(spark, d)
    clusters = materialize(hotspots.cluster_statistics(assigned))
    summary = materialize(trend.trend_summary(trend.daily_grid(trend.daily_counts(geo))))
    found = materialize(trend.anomalies(summary))
    return geo, clusters, materialize(trend.series_statistics(summary, found)), found, summary, materialize(trend.spike_events(found))


def district_features(spark, d):
    return shaped(risk.district_features(*_risk_inputs(spark, d)))


def risk_scores(spark, d):
    scores, _ = risk.risk_scores(*_risk_inputs(spark, d))
    return shaped(scores)


def score_statistics(spark, d):
    return shaped(views.score_statistics(risk.risk_scores(*_risk_inputs(spark, d))[0]))


def active_hotspots(spark, d):
    tables = _risk_inputs(spark, d)
    return shaped(views.active_hotspot_counts(hotspots.relative_tiers(tables[1]), risk.risk_scores(*tables)[0]))


def district_cards(spark, d):
    tables = _risk_inputs(spark, d)
    geo = tables[0]
    spikes = trend.period_spikes(geo, geo.agg(F.max("occurrence_datetime")).scalar(), 7, 3, ("district",))
    return shaped(views.district_cards(risk.risk_scores(*tables)[0], spikes, geo))


def top_contributors(spark, d):
    f = risk.district_features(*_risk_inputs(spark, d))
    return shaped(risk.contributors(risk.normalized(f, list(risk.WEIGHTS)), risk.WEIGHTS))


def model_features(spark, d):
    geo = inputs.geo_incidents(spark, d)
    newest = F.to_date(geo.agg(F.max("occurrence_datetime")).scalar())
    target = (F.col("status") == "OPEN").cast("double")
    return shaped(risk_model.model_features(geo, newest, "crime_type", target, F.col("offender_id") % 2 == 0))


def _tier_rows(spark, d, label):
    geo = inputs.geo_incidents(spark, d)
    newest = F.to_date(geo.agg(F.max("occurrence_datetime")).scalar())
    return risk_model.raw_features(geo, newest, "crime_type", F.col("offender_id") % 2 == 0, F.col("property_loss") > 100, label)


def tier_model(spark, d):
    """Every incident that the trained model can place, with its known tier. The label is made from the status, which is no feature."""
    rows = _tier_rows(spark, d, F.when(F.col("status") == "OPEN", "HIGH").when(F.col("status") == "UNDER_INVESTIGATION", "MEDIUM").otherwise("LOW"))
    model, _ = risk_model.train_tier_model(rows)
    return model.transform(rows).where("prediction is not null").select("incident_id", F.col("label").alias("tier"))


def tier_metrics(spark, d):
    """Held-out figures of a model whose tier follows from the loss: how many rows it learnt from and was judged on, and whether it learnt the rule."""
    _, metrics = risk_model.train_tier_model(_tier_rows(spark, d, F.when(F.col("property_loss") > 60, "HIGH").otherwise("LOW")), folds=3, trees=20)
    value = F.col("value")
    return shaped(metrics.select("metric", F.when(F.col("metric").like("%rows"), value).otherwise((value >= 0.9).cast("double")).alias("value")))


def isolation_summary(spark, d):
    """How many orders are scored, whether flags follow the scores, and whether no more are flagged than the percentile implies."""
    scores = forest.isolation_scores(_gappy_orders(spark, d), feature_columns=_MATRIX_COLUMNS)
    rows, flagged = F.count(F.lit(1)), F.count_if("is_anomaly")
    return shaped(scores.agg(
        rows.alias("rows"), F.count_if(F.col("is_anomaly") != (F.col("anomaly_score") < 0)).alias("inconsistent"),
        ((flagged > 0) & (flagged <= F.floor(0.05 * (rows - 1)) + 1)).alias("within"),
    ))


def time_buckets(spark, d):
    e = inputs.event_incidents(spark, d)
    t = F.col("occurrence_datetime")
    return shaped(
        e.groupBy(timeparts.time_of_day(t).alias("time_of_day"), timeparts.six_hour_bucket(t).alias("quarter"), labels.type_category(F.col("crime_type")).alias("category"))
        .agg(F.count(F.lit(1)).alias("incidents"))
    )


def reporting_delay(spark, d):
    """Hours from order to shipment per order priority."""
    o, l = inputs.table(spark, d, "orders"), inputs.table(spark, d, "lineitem")
    hours = timeparts.hours_between(F.col("o_orderdate"), F.col("l_shipdate"))
    return shaped(
        l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.round(F.avg(hours), 3).alias("mean_hours"), F.min(hours).alias("least_hours"), F.max(hours).alias("most_hours"))
    )


_MATRIX_SQL = ORDERS + """, g AS (SELECT incident_id, CASE WHEN incident_id % 50 <> 0 THEN property_loss END AS property_loss, repeat_offender,
    coalesce(CASE WHEN incident_id % 41 <> 0 THEN status END, 'missing') AS status, segment, crime_type FROM inc),
f AS (SELECT *, coalesce(property_loss, (SELECT median(property_loss) FROM g)) AS p, CAST(repeat_offender AS INT)::DOUBLE AS r FROM g),
a AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(r) AS mr, stddev_pop(r) AS sr FROM f)"""


def _levels(column: str, values: list[str]) -> str:
    def name(v: str) -> str:
        return f"{column}_{v}".lower().replace("-", "_").replace(" ", "_")

    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"{name(v)}\"" for v in values)


_RISK = CLUSTER_STATS + ", " + TREND + """, per_trend AS (SELECT district, sum(total_incidents)::DOUBLE AS total_incidents, count(DISTINCT crime_type)::DOUBLE AS crime_diversity FROM statistics GROUP BY 1),
direction AS (SELECT district, trend_direction FROM (SELECT district, trend_direction, row_number() OVER (PARTITION BY district ORDER BY count(*) DESC, trend_direction) AS r
  FROM statistics GROUP BY 1, 2) WHERE r = 1),
per_cluster AS (SELECT district, count(*)::DOUBLE AS h, avg(severity_score) AS s, avg(density) AS de, avg(cluster_radius_metres) AS ra, sum(number_of_incidents)::DOUBLE AS n FROM cluster_stats GROUP BY 1),
per_anomaly AS (SELECT district, count(z_score)::DOUBLE AS n, avg(abs(z_score)) AS z FROM anomalies GROUP BY 1),
per_summary AS (SELECT district, avg(trend_strength_pct) AS t FROM summary GROUP BY 1),
per_spike AS (SELECT district, count(*)::DOUBLE AS n FROM spikes GROUP BY 1),
per_incident AS (SELECT district, avg(CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS r, avg(k) AS pd FROM inc GROUP BY 1),
features AS (
  SELECT i.district, coalesce(t.total_incidents, 0.0) AS total_incidents, coalesce(t.crime_diversity, 0.0) AS crime_diversity,
    coalesce(di.trend_direction, 'Stable') AS dominant_trend_direction, coalesce(c.h, 0.0) AS number_of_hotspots, coalesce(c.s, 0.0) AS average_hotspot_severity,
    coalesce(c.de, 0.0) AS average_hotspot_density, coalesce(c.ra, 0.0) AS average_hotspot_radius, coalesce(a.n, 0.0) AS trend_anomalies, coalesce(a.z, 0.0) AS average_z_score,
    coalesce(s.t, 0.0) AS average_trend_strength, coalesce(sp.n, 0.0) AS number_of_spike_events, coalesce(i.r, 0.0) AS repeat_offender_percentage,
    coalesce(t.total_incidents / nullif(i.pd, 0), 0.0) AS crime_rate, coalesce(coalesce(c.n, 0.0) / nullif(t.total_incidents, 0), 0.0) AS hotspot_coverage_ratio
  FROM per_incident i LEFT JOIN per_trend t USING (district) LEFT JOIN direction di USING (district) LEFT JOIN per_cluster c USING (district) LEFT JOIN per_anomaly a USING (district)
    LEFT JOIN per_summary s USING (district) LEFT JOIN per_spike sp USING (district))"""

_FEATURES = [f for f in risk.FEATURES if f != "dominant_trend_direction"]
_ROUNDED = ", ".join(f"round({f}, 6)::DOUBLE AS {f}" for f in _FEATURES)
_NORMAL = ", normal AS (SELECT *, " + ", ".join(
    f"CASE WHEN max({n}) OVER () = min({n}) OVER () THEN 0.5::DOUBLE ELSE ({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) END AS {n}_normalized" for n in risk.WEIGHTS
) + " FROM features), scores AS (SELECT *, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 * (" + " + ".join(f"{n}_normalized * {w}::DOUBLE" for n, w in risk.WEIGHTS.items()) + "))), 2) AS risk_score FROM normal)"

_LEVELS = "SELECT *, CASE WHEN risk_score <= 25 THEN 'low' WHEN risk_score <= 50 THEN 'moderate' WHEN risk_score <= 75 THEN 'high' ELSE 'critical' END AS level FROM scores"

QUERIES = {
    "score_statistics": (
        score_statistics,
        with_(_RISK + _NORMAL + f", l AS ({_LEVELS})", "SELECT count(*) AS districts_scored, round(avg(risk_score), 2) AS average_score, min(risk_score) AS lowest_score, max(risk_score) AS highest_score, "
              + ", ".join(f"count(*) FILTER (level = '{v}') AS {v}" for v in ("low", "moderate", "high", "critical")) + " FROM l", True),
    ),
    "active_hotspots": (
        active_hotspots,
        with_(_RISK + _NORMAL, "SELECT (SELECT count(*) FROM tiers WHERE risk_level = 'High') AS high_tier_hotspots, count(*) FILTER (risk_score > 60) AS scored_above_60 FROM scores", True),
    ),
    "district_cards": (
        district_cards,
        with_(_RISK + _NORMAL + """, aged AS (SELECT district, CAST((SELECT max(occurrence_datetime) FROM inc) AS DATE) - CAST(occurrence_datetime AS DATE) AS age FROM inc),
          c AS (SELECT district, count(*) FILTER (age < 7) AS n, (count(*) FILTER (age >= 7) / 3.0)::DOUBLE AS b FROM aged WHERE age < 28 GROUP BY 1),
          ch AS (SELECT district, n, round(100.0 * (n - b) / nullif(b, 0), 1) AS p FROM c),
          ty AS (SELECT district, crime_type, row_number() OVER (PARTITION BY district ORDER BY count(*) DESC, crime_type) AS r FROM inc GROUP BY 1, 2),
          tops AS (SELECT district, string_agg(crime_type, ',' ORDER BY r) AS top_crimes FROM ty WHERE r <= 3 GROUP BY 1)""",
          """SELECT s.district, s.risk_score, p AS change_percent, CASE WHEN p > 5 THEN 'rising' WHEN p < -5 THEN 'declining' ELSE 'stable' END AS trend, n AS current_count, top_crimes,
            CASE WHEN s.risk_score > 75 THEN 'critical' WHEN s.risk_score > 50 THEN 'high' WHEN s.risk_score > 30 THEN 'medium' ELSE 'low' END AS risk_level
          FROM scores s LEFT JOIN ch USING (district) LEFT JOIN tops USING (district)""", True),
    ),
    "feature_matrix": (
        feature_matrix,
        with_(_MATRIX_SQL, "SELECT CAST(incident_id AS VARCHAR) AS incident_id, round((p - mp) / sp, 6) AS property_loss, round((r - mr) / sr, 6) AS repeat_offender, "
              + _levels("status", ["open", "under_review", "closed", "missing"]) + ", " + _levels("segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + ", "
              + _levels("crime_type", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + " FROM f CROSS JOIN a"),
    ),
    "isolation_scores": (isolation_scores, None),
    "isolation_summary": (isolation_summary, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS inconsistent, true AS within FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "district_features": (district_features, with_(_RISK, f"SELECT district, dominant_trend_direction, {_ROUNDED} FROM features", True)),
    "risk_scores": (
        risk_scores,
        with_(_RISK + _NORMAL, f"SELECT district, dominant_trend_direction, {_ROUNDED}, " + ", ".join(f"round({n}_normalized, 6) AS {n}_normalized" for n in risk.WEIGHTS)
              + """, risk_score, CASE WHEN risk_score <= 25 THEN 'Low' WHEN risk_score <= 50 THEN 'Moderate' WHEN risk_score <= 75 THEN 'High' ELSE 'Critical' END AS risk_level FROM scores""", True),
    ),
    "top_contributors": (
        top_contributors,
        with_(_RISK + _NORMAL + ", parts AS (" + " UNION ALL ".join(f"SELECT district, '{n}' AS feature, {n}_normalized * {w}::DOUBLE * 100 AS points FROM normal" for n, w in risk.WEIGHTS.items())
              + "), ranked AS (SELECT district, feature, points, row_number() OVER (PARTITION BY district ORDER BY points DESC, feature) AS rank FROM parts)",
              "SELECT district, round(points, 6) AS points, feature, rank FROM ranked WHERE rank <= 3", True),
    ),
    "model_features": (
        model_features,
        with_(GEO + f""", newest AS (SELECT CAST(max(occurrence_datetime) AS DATE) AS d FROM inc),
          aged AS (SELECT police_station, d - CAST(occurrence_datetime AS DATE) AS age FROM inc CROSS JOIN newest),
          station AS (SELECT police_station, ln((1.0 + count(*) FILTER (age >= 0 AND age < 30)) / (1.0 + count(*) FILTER (age >= 0 AND age < 365) * (30 / 365::DOUBLE))) AS ratio FROM aged GROUP BY 1),
          codes AS (SELECT crime_type, avg(CASE WHEN status = 'OPEN' THEN 1.0::DOUBLE ELSE 0.0 END) AS w FROM inc GROUP BY 1),
          near AS (SELECT a.incident_id, count(*) - 1 AS n FROM geo a JOIN geo b ON abs(a.latitude - b.latitude) < 0.01 AND abs(a.longitude - b.longitude) < 0.02
            WHERE {METRES.format(a='a', b='b')} <= 1000 GROUP BY 1)""",
          """SELECT g.incident_id, round(s.ratio, 6) AS station_ratio, round(c.w, 6) AS mo_weight, n.n AS spatial_density_1km,
            CASE WHEN g.offender_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS prior_offender,
            round((property_loss - min(property_loss) OVER ()) / (max(property_loss) OVER () - min(property_loss) OVER ()), 6) AS property_loss_scaled,
            CASE WHEN hour(occurrence_datetime) < 6 THEN 'Night' WHEN hour(occurrence_datetime) < 12 THEN 'Morning' WHEN hour(occurrence_datetime) < 18 THEN 'Afternoon' ELSE 'Evening' END AS time_bucket,
            CASE WHEN status = 'OPEN' THEN 1.0::DOUBLE ELSE 0.0 END AS target
          FROM geo g JOIN station s USING (police_station) JOIN codes c USING (crime_type) JOIN near n USING (incident_id)"""),
    ),
    "tier_model": (
        tier_model,
        with_(EVENTS, "SELECT incident_id, CASE status WHEN 'OPEN' THEN 'HIGH' WHEN 'UNDER_INVESTIGATION' THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM inc"),
    ),
    "tier_metrics": (
        tier_metrics,
        with_(EVENTS + ", held AS (SELECT CAST('0x' || substr(md5(CAST(incident_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 AS h FROM inc)",
              """SELECT 'train_rows' AS metric, count(*) FILTER (NOT h)::DOUBLE AS value FROM held UNION ALL SELECT 'held_out_rows', count(*) FILTER (h)::DOUBLE FROM held
              UNION ALL SELECT unnest(['validation_f1', 'f1', 'auc']), 1.0::DOUBLE"""),
    ),
    "time_buckets": (
        time_buckets,
        with_(EVENTS + ", h AS (SELECT *, hour(occurrence_datetime) AS h FROM inc)",
              """SELECT CASE WHEN h >= 5 AND h < 12 THEN 'Morning' WHEN h >= 12 AND h < 17 THEN 'Afternoon' WHEN h >= 17 AND h < 21 THEN 'Evening' ELSE 'Night' END AS time_of_day,
              CASE WHEN h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning' WHEN h < 18 THEN 'Afternoon' ELSE 'Evening' END AS quarter,
              CASE crime_type WHEN 'Theft' THEN 'Property Crime' WHEN 'Burglary' THEN 'Property Crime' WHEN 'Fraud' THEN 'White Collar Crime' ELSE 'Violent Crime' END AS category,
              count(*) AS incidents FROM h GROUP BY 1, 2, 3"""),
    ),
    "reporting_delay": (
        reporting_delay,
        """WITH h AS (SELECT o_orderpriority, date_diff('second', o_orderdate, l_shipdate) / 3600.0::DOUBLE AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT o_orderpriority, round(avg(h), 3) AS mean_hours, round(min(h), 6) AS least_hours, round(max(h), 6) AS most_hours FROM h GROUP BY 1""",
    ),
}
