"""Shared pieces of the registered queries and of their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shaped(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: integers as bigint, doubles rounded, arrays as comma-joined text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        columns.append(c.alias(f.name))
    return df.select(*columns)


EVENTS = """inc AS (
  SELECT event_id AS incident_id,
    CASE event_type WHEN 'view' THEN 'Theft' WHEN 'click' THEN 'Burglary' WHEN 'signup' THEN 'Assault'
      WHEN 'purchase' THEN 'Fraud' WHEN 'error' THEN 'Robbery' END AS crime_type,
    'D' || CAST(user_id % 10 AS VARCHAR) AS district, 'S' || CAST(user_id % 50 AS VARCHAR) AS police_station,
    ts AS occurrence_datetime, user_id AS offender_id, value AS property_loss,
    CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'UNDER_INVESTIGATION' ELSE 'CLOSED' END AS status,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

GEO = EVENTS + """, geo AS (
  SELECT *,
    CAST(12.0 AS DOUBLE) + CAST(offender_id % 10 AS DOUBLE) * CAST(0.7 AS DOUBLE)
      + (CAST((incident_id * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) - CAST(0.5 AS DOUBLE))
      * CASE WHEN incident_id % 20 = 0 THEN CAST(0.004 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS latitude,
    CAST(75.0 AS DOUBLE) + CAST(offender_id % 10 AS DOUBLE) * CAST(0.3 AS DOUBLE)
      + (CAST((incident_id * 104729) % 10009 AS DOUBLE) / CAST(10009 AS DOUBLE) - CAST(0.5 AS DOUBLE))
      * CASE WHEN incident_id % 20 = 0 THEN CAST(0.004 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS longitude
  FROM inc)"""

ORDERS = """inc AS (
  SELECT o_orderkey AS incident_id, o_orderpriority AS crime_type, n_name AS district, o_orderdate AS occurrence_datetime,
    o_custkey AS offender_id, o_totalprice AS property_loss,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'under_review' WHEN 'F' THEN 'closed' END AS status,
    count(*) OVER (PARTITION BY o_custkey) >= 10 AS repeat_offender, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

FLAGS = """flags AS (
  SELECT event_id AS flag_id,
    CASE event_type WHEN 'view' THEN 'HOTSPOT' WHEN 'click' THEN 'MO_LINK' WHEN 'signup' THEN 'ANOMALY'
      WHEN 'purchase' THEN 'EMERGING_TREND' WHEN 'error' THEN 'RISK_SCORE' END AS flag_type,
    CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 75 THEN 'HIGH' WHEN value >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    'Alert ' || event_type || ' S' || CAST(user_id % 50 AS VARCHAR) AS title, value / 500.0 AS confidence_score,
    CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'ESCALATED' ELSE 'DISMISSED' END AS status,
    'T' || CAST(user_id % 50 AS VARCHAR) AS target_id, 'S' || CAST(user_id % 50 AS VARCHAR) AS jurisdiction_id, ts AS created_at
  FROM events)"""

DECISIONS = """decisions AS (
  SELECT event_id * 2 + step AS decision_id, event_id AS flag_id, 'U' || CAST(user_id AS VARCHAR) AS reviewer_id,
    CASE (event_id // 3 + step) % 3 WHEN 0 THEN 'ACKNOWLEDGE' WHEN 1 THEN 'ESCALATE' ELSE 'DISMISS' END AS decision,
    'reason ' || CAST(step AS VARCHAR) AS reason, ts + step * INTERVAL 1 HOUR AS created_at
  FROM events CROSS JOIN (SELECT CAST(unnest([1, 2]) AS BIGINT) AS step))"""

COUNTS = """counts AS (
  SELECT CAST(occurrence_datetime AS DATE) AS date, district, crime_type, count(*) AS n FROM inc GROUP BY 1, 2, 3),
grid AS (
  SELECT d.date, a.district, b.crime_type, CAST(coalesce(c.n, 0) AS BIGINT) AS daily_incidents
  FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM counts), (SELECT max(date) FROM counts), INTERVAL 1 DAY)) AS DATE) AS date) d
  CROSS JOIN (SELECT DISTINCT district FROM counts) a CROSS JOIN (SELECT DISTINCT crime_type FROM counts) b
  LEFT JOIN counts c ON c.date = d.date AND c.district = a.district AND c.crime_type = b.crime_type)"""

TREND = COUNTS + """, averaged AS (
  SELECT *, avg(daily_incidents) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_average_7,
    avg(daily_incidents) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS moving_average_30,
    lag(daily_incidents, 1) OVER w AS l1, lag(daily_incidents, 7) OVER w AS l7,
    count(daily_incidents) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS seen,
    avg(daily_incidents) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS m,
    stddev_samp(daily_incidents) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s
  FROM grid WINDOW w AS (PARTITION BY district, crime_type ORDER BY date)),
changed AS (
  SELECT *, lag(moving_average_7, 7) OVER (PARTITION BY district, crime_type ORDER BY date) AS lm FROM averaged),
measured AS (
  SELECT *, CASE WHEN coalesce(l1, 0) = 0 THEN 0.0 ELSE CAST(daily_incidents AS DOUBLE) / l1 - 1 END AS daily_growth_rate,
    CASE WHEN coalesce(l7, 0) = 0 THEN 0.0 ELSE CAST(daily_incidents AS DOUBLE) / l7 - 1 END AS weekly_growth_rate,
    CASE WHEN coalesce(lm, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE moving_average_7 / lm - 1 END AS change,
    CASE WHEN seen >= 10 THEN m END AS rolling_mean, CASE WHEN seen >= 10 THEN s END AS rolling_std
  FROM changed),
summary AS (
  SELECT *, round(change * 100, 2) AS trend_strength_pct,
    CASE WHEN change > 0.05 THEN 'Increasing' WHEN change < -0.05 THEN 'Decreasing' ELSE 'Stable' END AS trend_direction,
    CASE WHEN rolling_std > 0 THEN (daily_incidents - rolling_mean) / rolling_std END AS z
  FROM measured),
anomalies AS (
  SELECT date, district, crime_type, daily_incidents AS incident_count, round(rolling_mean, 2) AS expected_count, round(z, 3) AS z_score,
    CASE WHEN abs(round(z, 3)) >= 5 THEN 'Critical' WHEN abs(round(z, 3)) >= 4 THEN 'High' ELSE 'Moderate' END AS severity
  FROM summary WHERE abs(z) >= 3),
runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY district, crime_type ORDER BY date ROWS UNBOUNDED PRECEDING) AS ev FROM (
    SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY district, crime_type ORDER BY date) = 1 THEN 0 ELSE 1 END AS fresh FROM anomalies)),
spikes AS (
  SELECT district, crime_type, min(date) AS spike_start, max(date) AS spike_end, CAST(max(date) - min(date) + 1 AS BIGINT) AS duration_days,
    max(incident_count) AS peak_incident_count, arg_max(z_score, abs(z_score) * 1e6 - (date - DATE '1970-01-01') * 1e-3) AS peak_z_score,
    CASE max(CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 ELSE 1 END) WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' ELSE 'Moderate' END AS severity
  FROM runs GROUP BY district, crime_type, ev),
statistics AS (
  SELECT b.district, b.crime_type, b.total_incidents, b.average_daily_incidents, b.maximum_daily_incidents,
    CAST(coalesce(n, 0) AS BIGINT) AS number_of_spikes, b.trend_direction
  FROM (SELECT district, crime_type, CAST(sum(daily_incidents) AS BIGINT) AS total_incidents, round(avg(daily_incidents), 3) AS average_daily_incidents,
          max(daily_incidents) AS maximum_daily_incidents, arg_max(trend_direction, date) AS trend_direction FROM summary GROUP BY 1, 2) b
  LEFT JOIN (SELECT district, crime_type, count(*) AS n FROM anomalies GROUP BY 1, 2) a USING (district, crime_type))"""

METRES = """2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0,
      pow(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2)
      + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2)))))"""


def metres(a: str, b: str) -> str:
    return METRES.format(a=a, b=b)


# Brute force over all pairs in one latitude strip; for the small check tables only.
CLUSTERS = GEO + f""", near AS (
  SELECT a.incident_id AS a, b.incident_id AS b FROM geo a JOIN geo b ON abs(a.latitude - b.latitude) < 0.003 AND abs(a.longitude - b.longitude) < 0.01
  WHERE {metres('a', 'b')} <= 300),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 10),
reach AS (
  SELECT id AS root, id FROM core
  UNION
  SELECT r.root, n.b FROM reach r JOIN near n ON n.a = r.id JOIN core c ON c.id = n.b),
firsts AS (SELECT id, min(root) AS f FROM reach GROUP BY id),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY f) - 1 AS label FROM firsts),
labelled AS (
  SELECT n.a AS id, min(l.label) AS label FROM near n JOIN numbered l ON l.id = n.b
  WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a
  UNION ALL SELECT id, label FROM numbered),
clustered AS (SELECT g.*, CAST(coalesce(l.label, -1) AS BIGINT) AS cluster_id FROM geo g LEFT JOIN labelled l ON l.id = g.incident_id)"""

CLUSTER_STATS = CLUSTERS + f""", members AS (SELECT * FROM clustered WHERE cluster_id <> -1),
centre AS (SELECT cluster_id, median(latitude) AS latitude, median(longitude) AS longitude FROM members GROUP BY 1),
far AS (SELECT m.cluster_id, {metres('c', 'm')} AS d FROM members m JOIN centre c USING (cluster_id)),
radius AS (SELECT cluster_id, quantile_cont(d, 0.95) AS r95, max(d) AS rmax FROM far GROUP BY 1),
district_mode AS (SELECT cluster_id, district FROM (SELECT cluster_id, district, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, district) AS r
  FROM members GROUP BY cluster_id, district) WHERE r = 1),
crime_mode AS (SELECT cluster_id, crime_type FROM (SELECT cluster_id, crime_type, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, crime_type) AS r
  FROM members GROUP BY cluster_id, crime_type) WHERE r = 1),
base AS (
  SELECT cluster_id, count(*) AS number_of_incidents, CAST(sum(CASE crime_type WHEN 'Robbery' THEN 5 WHEN 'Assault' THEN 3 WHEN 'Burglary' THEN 3 WHEN 'Fraud' THEN 2 ELSE 1 END) AS DOUBLE) AS severity_score,
    count(DISTINCT crime_type) AS unique_crime_types, count(DISTINCT offender_id) AS unique_offenders,
    min(occurrence_datetime) AS first_incident_date, max(occurrence_datetime) AS last_incident_date
  FROM members GROUP BY 1),
cluster_stats AS (
  SELECT b.cluster_id, dm.district, round(c.latitude, 6) AS centre_latitude, round(c.longitude, 6) AS centre_longitude, b.number_of_incidents,
    round(r.r95, 2) AS cluster_radius_metres, round(r.rmax, 2) AS cluster_radius_max_metres,
    CASE WHEN r.r95 > 0 THEN round(b.number_of_incidents / (pi() * r.r95 * r.r95), 6) END AS density, cm.crime_type AS most_common_crime,
    b.severity_score, b.unique_crime_types, b.unique_offenders, b.first_incident_date, b.last_incident_date
  FROM base b JOIN centre c USING (cluster_id) JOIN radius r USING (cluster_id) JOIN district_mode dm USING (cluster_id) JOIN crime_mode cm USING (cluster_id)),
tiers AS (
  SELECT s.*, CASE WHEN q.lo = q.hi THEN 'Medium' WHEN severity_score >= q.h THEN 'High' WHEN severity_score >= q.l THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM cluster_stats s CROSS JOIN (SELECT min(severity_score) AS lo, max(severity_score) AS hi, quantile_cont(severity_score, 1.0 / 3) AS l,
    quantile_cont(severity_score, 2.0 / 3) AS h FROM cluster_stats) q)"""


def with_(cte: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{cte}\n{select}"
