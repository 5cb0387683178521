"""Registered queries: cleaning, distances, density, hotspots and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.geo import haversine_m
from ...operators import cleaning, dbscan, hotspots, quality
from ...operators.radius import neighbour_counts
from ...operators.scale import dense_index, materialize
from .. import inputs
from .common import CLUSTER_STATS, CLUSTERS, EVENTS, FLAGS, GEO, METRES, metres, shaped, with_


def clean_incidents(spark, d):
    return shaped(cleaning.clean_coordinates(inputs.unclean_incidents(spark, d)))


def rule_violations(spark, d):
    checked = quality.violations(inputs.intake_payloads(spark, d), quality.intake_rules())
    return shaped(
        checked.select("event_id", F.size("field_errors").alias("errors"), F.transform("field_errors", lambda e: e["field"]).alias("fields"))
    )


def fk_violations(spark, d):
    tables = {t: inputs.table(spark, d, t) for t in ("events", "supplier", "lineitem", "orders", "labels", "documents")}
    keys = {"events.user_id": "supplier.s_suppkey", "lineitem.l_orderkey": "orders.o_orderkey", "labels.doc_id": "documents.doc_id"}
    return shaped(quality.foreign_key_report(tables, keys))


def enum_violations(spark, d):
    """Every seventh flag has its severity in the place of its type; all spellings of the known types are accepted."""
    mixed = inputs.event_flags(spark, d).withColumn("flag_type", F.when(F.col("flag_id") % 7 == 0, F.col("severity")).otherwise(F.col("flag_type")))
    flags = quality.violations(mixed, [quality.flag_type_rule()])
    broken = flags.where(F.size("field_errors") > 0)
    return shaped(broken.groupBy("flag_type").agg(F.count(F.lit(1)).alias("rows")))


def distance_to_centre(spark, d):
    geo = inputs.geo_incidents(spark, d)
    n = (F.col("offender_id") % 10).cast("double")
    metre = haversine_m(F.lit(12.0) + n * 0.7, F.lit(75.0) + n * 0.3, F.col("latitude"), F.col("longitude"))
    return shaped(geo.select("incident_id", F.round(metre, 3).alias("metres")))


def neighbour_density(spark, d):
    found = neighbour_counts(inputs.geo_incidents(spark, d), 1000.0)
    return shaped(found, 9)


def grid_hotspots(spark, d):
    return shaped(hotspots.grid_hotspots(inputs.geo_incidents(spark, d)), 9)


def dbscan_assignments(spark, d):
    return shaped(dbscan.assignments(dbscan.assign_clusters(inputs.geo_incidents(spark, d))), 9)


def _stats(spark, d):
    clustered = materialize(dbscan.assign_clusters(inputs.geo_incidents(spark, d)))
    return materialize(hotspots.cluster_statistics(clustered))


def cluster_stats(spark, d):
    return shaped(_stats(spark, d))


def cluster_tiers(spark, d):
    return shaped(hotspots.relative_tiers(_stats(spark, d)).select("cluster_id", "severity_score", "risk_level"))


def case_numbers(spark, d):
    """Serial number per (district, station, type, year) and the number built from it."""
    e = inputs.event_incidents(spark, d).withColumn("year", F.year("occurrence_datetime")).select(
        "incident_id", "district", "police_station", "crime_type", "year"
    )
    serial = dense_index(e, ["incident_id"], "serial", ["district", "police_station", "crime_type", "year"])
    number = F.format_string("%s/%s/%s/%04d/%05d", "district", "police_station", F.upper(F.substring("crime_type", 1, 2)), "year", F.col("serial") + 1)
    return shaped(serial.select("incident_id", (F.col("serial") + 1).alias("serial"), number.alias("case_number")))


QUERIES = {
    "clean_incidents": (
        clean_incidents,
        with_(EVENTS + """, raw AS (SELECT CASE WHEN incident_id % 31 <> 0 THEN incident_id END AS incident_id, crime_type, district,
            CASE WHEN incident_id % 17 = 0 THEN 'north' ELSE CAST(k AS VARCHAR) END AS la, CASE WHEN incident_id % 19 <> 0 THEN CAST(k * 2 AS VARCHAR) END AS lo,
            CASE WHEN incident_id % 29 = 0 THEN 'unknown' ELSE '2024-01-15 10:00:00' END AS t FROM inc),
          typed AS (SELECT incident_id, crime_type, district, TRY_CAST(la AS DOUBLE) AS latitude, TRY_CAST(lo AS DOUBLE) AS longitude,
            TRY_CAST(t AS TIMESTAMP) AS occurrence_datetime FROM raw)""",
          """SELECT * FROM typed WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
          AND occurrence_datetime IS NOT NULL AND incident_id IS NOT NULL"""),
    ),
    "rule_violations": (
        rule_violations,
        """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        f AS (SELECT event_id, list_filter([
            CASE WHEN k < 5 THEN 'fir_number' END, CASE WHEN event_type = 'signup' THEN 'incident_type' END,
            CASE WHEN event_id % 7 = 0 THEN 'reported_at' END, CASE WHEN event_id % 11 = 0 THEN 'created_by' END,
            CASE WHEN event_id % 13 = 0 THEN 'location' END,
            CASE WHEN event_id % 13 <> 0 AND (k > 90 OR k * 2 > 180) THEN 'location.latitude/longitude' END,
            CASE WHEN event_id % 13 <> 0 AND event_id % 5 = 0 THEN 'location.district_id' END], lambda x: x IS NOT NULL) AS l FROM e)
        SELECT event_id, CAST(len(l) AS BIGINT) AS errors, coalesce(array_to_string(l, ','), '') AS fields FROM f""",
    ),
    "fk_violations": (
        fk_violations,
        """SELECT 'events.user_id' AS "constraint", CAST(user_id AS VARCHAR) AS key, count(*) AS rows FROM events
          WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id
        UNION ALL SELECT 'lineitem.l_orderkey', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
          WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
        UNION ALL SELECT 'labels.doc_id', CAST(doc_id AS VARCHAR), count(*) FROM labels
          WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id""",
    ),
    "duplicate_keys": (
        lambda s, d: shaped(quality.duplicate_keys(inputs.table(s, d, "lineitem"), ["l_orderkey", "l_suppkey"])),
        "SELECT l_orderkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "enum_violations": (
        enum_violations,
        with_(FLAGS, """SELECT t AS flag_type, count(*) AS rows FROM (SELECT CASE WHEN flag_id % 7 = 0 THEN severity ELSE flag_type END AS t FROM flags)
          WHERE lower(t) NOT IN ('hotspot', 'mo_link', 'mo_match', 'emerging_trend', 'anomaly', 'risk_score') GROUP BY 1"""),
    ),
    "distance_to_centre": (
        distance_to_centre,
        with_(GEO + """, c AS (SELECT incident_id, CAST(12.0 AS DOUBLE) + CAST(offender_id % 10 AS DOUBLE) * CAST(0.7 AS DOUBLE) AS latitude,
            CAST(75.0 AS DOUBLE) + CAST(offender_id % 10 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS longitude FROM inc)""",
          f"SELECT g.incident_id, round({metres('c', 'g')}, 3) AS metres FROM geo g JOIN c USING (incident_id)"),
    ),
    "neighbour_density": (
        neighbour_density,
        with_(GEO + f""", p AS (SELECT latitude, longitude, count(*) AS n FROM geo GROUP BY 1, 2)""",
          f"""SELECT round(a.latitude, 9) AS latitude, round(a.longitude, 9) AS longitude, a.n AS rows_here, CAST(sum(b.n) - 1 AS BIGINT) AS neighbours
          FROM p a JOIN p b ON abs(a.latitude - b.latitude) < 0.01 AND abs(a.longitude - b.longitude) < 0.02
          WHERE {METRES.format(a='a', b='b')} <= 1000 GROUP BY a.latitude, a.longitude, a.n"""),
    ),
    "grid_hotspots": (
        grid_hotspots,
        with_(GEO + """, c AS (SELECT police_station, CAST(round(latitude * 100) AS BIGINT) AS y, CAST(round(longitude * 100) AS BIGINT) AS x, count(*) AS n,
            arg_min(district, incident_id) AS district, arg_min(latitude, incident_id) AS latitude, arg_min(longitude, incident_id) AS longitude,
            array_to_string(list_sort(list(DISTINCT crime_type)), ',') AS crime_types FROM geo GROUP BY 1, 2, 3)""",
          """SELECT printf('HS_%s_%.2f_%.2f', police_station, y / 100.0, x / 100.0) AS hotspot_id, police_station, district, round(latitude, 9) AS latitude,
          round(longitude, 9) AS longitude, n AS incident_count, crime_types, round(least(1.0, 0.4 + n * 0.1), 2)::DOUBLE AS risk_score FROM c WHERE n >= 3"""),
    ),
    "grid_members": (
        lambda s, d: shaped(hotspots.grid_members(inputs.geo_incidents(s, d))),
        with_(GEO + """, c AS (SELECT incident_id, police_station, CAST(round(latitude * 100) AS BIGINT) AS y, CAST(round(longitude * 100) AS BIGINT) AS x FROM geo),
          n AS (SELECT *, count(*) OVER (PARTITION BY police_station, y, x) AS n FROM c)""",
          "SELECT printf('HS_%s_%.2f_%.2f', police_station, y / 100.0, x / 100.0) AS hotspot_id, incident_id FROM n WHERE n >= 3"),
    ),
    "district_forecast": (
        lambda s, d: shaped(hotspots.district_forecast(inputs.geo_incidents(s, d))),
        with_(GEO + """, c AS (SELECT district, police_station, round(latitude * 100) AS y, round(longitude * 100) AS x, count(*) AS n FROM geo GROUP BY 1, 2, 3, 4),
          h AS (SELECT district, count(*) AS n, round(avg(round(least(1.0, 0.4 + n * 0.1), 2)::DOUBLE), 2) AS a FROM c WHERE n >= 3 GROUP BY 1)""",
          """SELECT t.district, t.n AS total_incidents, coalesce(h.n, 0) AS hotspot_count, coalesce(h.a, 0.0)::DOUBLE AS risk_score_avg
          FROM (SELECT district, count(*) AS n FROM inc GROUP BY 1) t LEFT JOIN h USING (district)"""),
    ),
    "dbscan_assignments": (
        dbscan_assignments,
        with_(CLUSTERS, """SELECT incident_id, cluster_id, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude, district FROM clustered""", True),
    ),
    "cluster_stats": (cluster_stats, with_(CLUSTER_STATS, "SELECT * FROM cluster_stats", True)),
    "cluster_tiers": (cluster_tiers, with_(CLUSTER_STATS, "SELECT cluster_id, severity_score, risk_level FROM tiers", True)),
    "case_numbers": (
        case_numbers,
        with_(EVENTS + """, s AS (SELECT *, year(occurrence_datetime) AS y, row_number() OVER (PARTITION BY district, police_station, crime_type,
            year(occurrence_datetime) ORDER BY incident_id) AS serial FROM inc)""",
          """SELECT incident_id, serial, printf('%s/%s/%s/%04d/%05d', district, police_station, upper(substr(crime_type, 1, 2)), y, serial) AS case_number FROM s"""),
    ),
}
