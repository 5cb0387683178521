"""Registered queries: flags, review decisions and role views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import filters, flags, graph, hotspots, linkage, review, trend, views
from .. import batch, inputs
from .common import DECISIONS, EVENTS, FLAGS, GEO, ORDERS, TREND, shaped, with_

_NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _newest(df):
    return df.agg(F.max("occurrence_datetime")).scalar()


def new_flags(spark, d):
    """Hotspot and trend flags that have no pending duplicate among the event flags."""
    geo = inputs.geo_incidents(spark, d)
    old = inputs.event_flags(spark, d).withColumn("title", F.concat("title", F.when(F.col("target_id") == "T7", " Fraud").otherwise("")))
    spots = flags.without_pending_target(flags.hotspot_flags(hotspots.grid_hotspots(geo), _now()), old)
    spikes = trend.period_spikes(geo, _newest(geo), 7, 3)
    trends = flags.without_pending_type(flags.trend_flags(spikes, _now()), old)
    return shaped(spots.unionByName(trends).select("flag_id", "flag_type", "severity", "title", "summary", "confidence_score", "target_type", "target_id", "status"))


def pending_dedupe(spark, d):
    """One raised flag per target that has no pending flag: dismissed flags raised again."""
    f = inputs.event_flags(spark, d)
    f = f.withColumn("target_id", F.concat_ws("-", "target_id", "flag_type", F.floor(F.col("flag_id") / 1000).cast("string")))
    return shaped(flags.without_pending_target(f.where("status = 'DISMISSED'"), f).select("flag_id", "target_id"))


def created_flags(spark, d):
    requests = inputs.event_flags(spark, d).select(
        "flag_id", F.when(F.col("flag_id") % 3 != 0, F.col("flag_type")).alias("flag_type"), F.when(F.col("flag_id") % 5 != 0, F.col("target_id")).alias("target_id")
    )
    return shaped(flags.create_flags(requests, _now()).drop("created_at", "title", "summary", "evidence_payload"))


def current_status(spark, d):
    now = review.current_flags(inputs.event_flags(spark, d), inputs.event_decisions(spark, d))
    return shaped(now.select("flag_id", "status", "review_reason"))


def checked_decisions(spark, d):
    f = inputs.event_flags(spark, d)
    asked = inputs.event_decisions(spark, d).select(
        "decision_id", F.when(F.col("decision_id") % 11 == 0, -F.col("flag_id") - 1).otherwise(F.col("flag_id")).alias("flag_id"), F.when(F.col("decision_id") % 5 == 0, "POSTPONE").otherwise(F.lower("decision")).alias("decision"),
        F.when(F.col("decision_id") % 7 != 0, F.col("reason")).alias("reason"),
    )
    good, bad = review.check_decisions(asked, f)
    return shaped(
        good.select("decision_id", "decision", F.lit("").alias("problems")).unionByName(
            bad.select("decision_id", F.upper("decision").alias("decision"), F.array_join(F.transform("field_errors", lambda e: e["message"]), "|").alias("problems"))
        )
    )


def routed_actions(spark, d):
    r = review.route(inputs.event_decisions(spark, d), inputs.event_flags(spark, d))
    keys = ["decision_id", "flag_id", "end_status"]
    return shaped(
        review.ground_actions(r).select(*keys, F.col("flag_target").alias("detail"))
        .unionByName(review.notifications(r).select(*keys, F.col("subject").alias("detail")))
        .unionByName(review.dismissals(r).select(*keys, F.col("rejection_reason").alias("detail")))
    )


def feedback_stats(spark, d):
    decisions = inputs.event_decisions(spark, d)
    outcomes = decisions.select("decision_id", F.when(F.col("decision_id") % 2 == 0, "arrest_made").otherwise("no_further_action").alias("outcome_type"))
    stats = review.feedback_statistics(inputs.event_flags(spark, d), decisions, outcomes)
    return shaped(stats.withColumn("arrests", F.try_element_at("outcomes", F.lit("arrest_made"))).drop("outcomes"))


def role_projection(spark, d):
    """Incident and victim rows as a constable may see them: without the victim."""
    cases, victims = inputs.order_case_graph(spark, d)
    return shaped(filters.for_role(cases.join(victims, "incident_id"), "constable").drop("repeat_offender"))


def constable_flags(spark, d):
    return shaped(filters.in_jurisdiction(inputs.event_flags(spark, d), "S7").select("flag_id", "severity", "status"))


def sp_flags(spark, d):
    return shaped(filters.serious_or_escalated(inputs.event_flags(spark, d)).select("flag_id", "severity", "status"))


def map_filter(spark, d):
    f = inputs.event_flags(spark, d).withColumnsRenamed({"jurisdiction_id": "district", "flag_type": "category"})
    return shaped(filters.on_map(f, "S3", ["HIGH", "CRITICAL"], ["HOTSPOT", "ANOMALY"]).select("flag_id", "severity", "category"))


def recent_incidents(spark, d):
    e = inputs.event_incidents(spark, d)
    return shaped(filters.recent(filters.equals(e, district="D4"), _newest(e), 7).select("incident_id", "occurrence_datetime"))


def dashboard_stats(spark, d):
    geo = inputs.geo_incidents(spark, d).withColumn("reported_datetime", F.col("occurrence_datetime") + F.make_dt_interval(hours=F.col("k").cast("int")))
    return shaped(views.dashboard_stats(geo, inputs.event_flags(spark, d), hotspots.grid_hotspots(geo), _newest(geo)))


def category_series(spark, d):
    m = views.category_series(inputs.event_incidents(spark, d))
    kinds = ["Assault", "Burglary", "Fraud", "Robbery", "Theft"]
    return shaped(m.select("date", "total", *[F.coalesce(F.try_element_at("by_category", F.lit(k)), F.lit(0)).alias(k.lower()) for k in kinds]))


def summary_facts(spark, d):
    from ...operators.scale import materialize

    o = inputs.order_incidents(spark, d)
    grid = materialize(trend.daily_grid(trend.daily_counts(o)))
    summary = trend.trend_summary(grid)
    found = materialize(trend.anomalies(summary))
    stats = trend.series_statistics(summary, found)
    events, ranking = trend.spike_events(found), trend.district_ranking(grid, found)
    sizes = o.groupBy("offender_id").agg(F.count(F.lit(1)).alias("number_of_incidents")).withColumnRenamed("offender_id", "cluster_id")
    scores = ranking.select("district", F.col("average_daily_incidents").alias("risk_score"))
    return shaped(views.summary_facts(stats, events, ranking, sizes, scores))


def repeat_people(spark, d):
    """Customers with at least ten orders, as people with a prior record."""
    o = inputs.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    people = inputs.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("offender_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("risk_tier"), F.lit(None).cast("string").alias("vehicle_no"),
        F.coalesce("n", F.lit(0)).alias("prior_cases_count"), (F.coalesce("n", F.lit(0)) >= 10).alias("prior_record_flag"),
    )
    return shaped(filters.repeat_people(people))


def incident_summary(spark, d):
    geo = inputs.geo_incidents(spark, d)
    nested = geo.select(
        "incident_id", F.concat(F.lit("F-"), F.col("incident_id").cast("string")).alias("fir_number"), F.col("crime_type").alias("title"), F.col("crime_type").alias("category"),
        F.lit("low").alias("severity"), "status",
        F.struct("district", "police_station", F.array(F.round("latitude", 4), F.round("longitude", 4)).alias("coordinates")).alias("location"), "occurrence_datetime",
    )
    out = filters.incident_summary(nested)
    return shaped(out.withColumn("latitude", F.col("coordinates")[0]).drop("coordinates"))


def star_join(spark, d):
    """Orders as incidents, customers as locations, nations as districts."""
    incidents = inputs.table(spark, d, "orders").select(F.col("o_orderkey").alias("incident_id"), F.col("o_custkey").alias("location_id"))
    places = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("location_id"), F.col("c_nationkey").alias("district_id"), F.col("c_mktsegment").alias("location_type"))
    districts = inputs.table(spark, d, "nation").select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("name"))
    return shaped(linkage.star(incidents, places, districts))


def station_recent(spark, d):
    """The newest open cases of one station, as its house officer sees them."""
    view = views.sho_view(inputs.geo_incidents(spark, d), inputs.event_flags(spark, d), graph.graph_edges(inputs.event_case_graph(spark, d)), "S7")
    return shaped(view["recent_firs"].select("incident_id", "status", "occurrence_datetime"))


def nightly_cache(spark, d):
    rows = batch.nightly_cache(inputs.geo_incidents(spark, d), _now())
    value = F.coalesce(F.get_json_object("payload", "$.total_incidents"), F.get_json_object("payload", "$.incident_count")).cast("bigint")
    return shaped(rows.select("cache_key", value.alias("incidents"), F.datediff("expires_at", "written_at").alias("days")))


_SPOTS = """, c AS (SELECT police_station, CAST(round(latitude * 100) AS BIGINT) AS y, CAST(round(longitude * 100) AS BIGINT) AS x, count(*) AS n,
  arg_min(latitude, incident_id) AS la, arg_min(longitude, incident_id) AS lo, array_to_string(list_sort(list(DISTINCT crime_type)), ', ') AS kinds FROM geo GROUP BY 1, 2, 3),
spots AS (SELECT printf('HS_%s_%.2f_%.2f', police_station, y / 100.0, x / 100.0) AS id, *, round(least(1.0, 0.4 + n * 0.1), 2)::DOUBLE AS score FROM c WHERE n >= 3),
aged AS (SELECT *, CAST((SELECT max(occurrence_datetime) FROM inc) AS DATE) - CAST(occurrence_datetime AS DATE) AS age FROM inc),
spike AS (SELECT crime_type, count(*) FILTER (age < 7) AS n, (count(*) FILTER (age >= 7) / 3.0)::DOUBLE AS b FROM aged WHERE age < 28 GROUP BY 1),
rated AS (SELECT *, round(100.0 * (n - b) / nullif(b, 0), 1) AS p FROM spike)"""

QUERIES = {
    "repeat_people": (
        repeat_people,
        """SELECT c_custkey AS offender_id, c_name AS name, c_mktsegment AS risk_tier, CAST(NULL AS VARCHAR) AS vehicle_no, count(*) AS prior_cases_count
          FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) >= 10""",
    ),
    "incident_summary": (
        incident_summary,
        with_(GEO, """SELECT incident_id, 'F-' || CAST(incident_id AS VARCHAR) AS fir_number, crime_type AS title, crime_type AS category, 'low' AS severity, status, district,
          police_station, occurrence_datetime, round(latitude, 4) AS latitude FROM geo"""),
    ),
    "star_join": (
        star_join,
        """SELECT o_orderkey AS incident_id, o_custkey AS location_id, CAST(c_nationkey AS BIGINT) AS district_id, c_mktsegment AS location_type, n_name AS name
          FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "station_recent": (
        station_recent,
        with_(EVENTS, """SELECT incident_id, status, occurrence_datetime FROM inc WHERE police_station = 'S7' AND status IN ('OPEN', 'UNDER_INVESTIGATION')
          ORDER BY occurrence_datetime DESC, incident_id LIMIT 15"""),
    ),
    "nightly_cache": (
        nightly_cache,
        with_(GEO + _SPOTS, """SELECT 'risk_forecast:' || district AS cache_key, count(*) AS incidents, 1::BIGINT AS days FROM inc GROUP BY district
          UNION ALL SELECT 'hotspot_scores_statewide:' || id, n, 7 FROM spots"""),
    ),
    "flag_filter": (
        lambda s, d: shaped(flags.newest_first(flags.filter_flags(inputs.event_flags(s, d), "pending", "hotspot", "medium", "S7")).select("flag_id", "severity", "status")),
        with_(FLAGS, "SELECT flag_id, severity, status FROM flags WHERE status = 'PENDING' AND flag_type = 'HOTSPOT' AND severity = 'MEDIUM' AND jurisdiction_id = 'S7'"),
    ),
    "flag_counts": (
        lambda s, d: shaped(flags.status_counts(inputs.event_flags(s, d))),
        with_(FLAGS, """SELECT count(*) AS total_flags, count(*) FILTER (status = 'PENDING') AS pending_count, count(*) FILTER (status = 'ACKNOWLEDGED') AS acknowledged_count,
          count(*) FILTER (status = 'ESCALATED') AS escalated_count, count(*) FILTER (status = 'DISMISSED') AS dismissed_count FROM flags"""),
    ),
    "flag_breakdown": (
        lambda s, d: shaped(flags.breakdown(inputs.event_flags(s, d))),
        with_(FLAGS, """SELECT 'severity' AS dimension, severity AS value, count(*) AS flags FROM flags GROUP BY 2
          UNION ALL SELECT 'flag_type', flag_type, count(*) FROM flags GROUP BY 2"""),
    ),
    "pending_counts": (
        lambda s, d: shaped(flags.pending_counts(inputs.event_flags(s, d))),
        with_(FLAGS, "SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'PENDING' AND severity = 'CRITICAL') AS critical_pending FROM flags"),
    ),
    "review_queue": (
        lambda s, d: shaped(flags.review_queue(inputs.event_flags(s, d)).select("flag_id", "severity", "status")),
        with_(FLAGS, """SELECT flag_id, severity, status FROM flags ORDER BY CASE WHEN status = 'PENDING' THEN 0 ELSE 1 END,
          CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, confidence_score DESC, flag_id"""),
    ),
    "new_flags": (
        new_flags,
        with_(GEO + _SPOTS, """SELECT 'FLAG_HS_' || id AS flag_id, 'HOTSPOT' AS flag_type, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
            'Spatial hotspot near ' || police_station AS title, printf('%d incidents near (%.4f, %.4f). Types: %s.', n, la, lo, kinds) AS summary, score AS confidence_score,
            'LOCATION' AS target_type, id AS target_id, 'PENDING' AS status FROM spots
          UNION ALL SELECT 'FLAG_TREND_ALL_' || crime_type, 'EMERGING_TREND', 'HIGH', 'Emerging trend: ' || crime_type || ' in ALL',
            printf('%s up by %.1f%% (%d against %.1f).', crime_type, p, n, b), 0.88, 'CATEGORY', crime_type, 'PENDING' FROM rated
            WHERE p >= 50 AND (crime_type <> 'Fraud' OR NOT EXISTS (SELECT 1 FROM events WHERE user_id % 50 = 7 AND event_id % 4 = 0))"""),
    ),
    "pending_dedupe": (
        pending_dedupe,
        with_(FLAGS + ", f AS (SELECT *, target_id || '-' || flag_type || '-' || CAST(flag_id // 1000 AS VARCHAR) AS t FROM flags)", """SELECT min(flag_id) AS flag_id, t AS target_id FROM f
          WHERE status = 'DISMISSED' AND t NOT IN (SELECT t FROM f WHERE status = 'PENDING') GROUP BY t"""),
    ),
    "created_flags": (
        created_flags,
        with_(FLAGS, """SELECT CAST(flag_id AS VARCHAR) AS flag_id, CASE WHEN flag_id % 3 <> 0 THEN flag_type ELSE 'HOTSPOT' END AS flag_type, 'MEDIUM' AS severity,
          0.85::DOUBLE AS confidence_score, 'LOCATION' AS target_type, CASE WHEN flag_id % 5 <> 0 THEN target_id ELSE 'UNKNOWN' END AS target_id,
          'UNKNOWN' AS jurisdiction_id, 'PENDING' AS status FROM flags"""),
    ),
    "current_status": (
        current_status,
        with_(FLAGS + ", " + DECISIONS + ", l AS (SELECT flag_id, arg_max(decision, decision_id) AS decision, arg_max(reason, decision_id) AS reason FROM decisions GROUP BY 1)",
              """SELECT f.flag_id, coalesce(CASE decision WHEN 'ACKNOWLEDGE' THEN 'ACKNOWLEDGED' WHEN 'ESCALATE' THEN 'ESCALATED' WHEN 'DISMISS' THEN 'DISMISSED' END, status) AS status,
              reason AS review_reason FROM flags f LEFT JOIN l USING (flag_id)"""),
    ),
    "checked_decisions": (
        checked_decisions,
        with_(FLAGS + ", " + DECISIONS + """, a AS (SELECT decision_id, CASE WHEN decision_id % 11 = 0 THEN -flag_id - 1 ELSE flag_id END AS flag_id, CASE WHEN decision_id % 5 = 0 THEN 'POSTPONE' ELSE decision END AS decision,
            CASE WHEN decision_id % 7 <> 0 THEN reason END AS reason FROM decisions)""",
          """SELECT decision_id, decision, concat_ws('|', CASE WHEN decision = 'POSTPONE' THEN 'must be one of: ACKNOWLEDGE, ESCALATE, DISMISS' END,
            CASE WHEN reason IS NULL THEN 'a reason is mandatory' END, CASE WHEN flag_id NOT IN (SELECT flag_id FROM flags) THEN 'flag not found' END) AS problems FROM a"""),
    ),
    "routed_actions": (
        routed_actions,
        with_(FLAGS + ", " + DECISIONS, """SELECT d.decision_id, d.flag_id, CASE decision WHEN 'ACKNOWLEDGE' THEN 'CLOSED_ACKNOWLEDGED' WHEN 'ESCALATE' THEN 'ESCALATED_PENDING_SP_REVIEW'
            ELSE 'CLOSED_DISMISSED' END AS end_status, CASE decision WHEN 'ACKNOWLEDGE' THEN target_id WHEN 'ESCALATE' THEN 'Escalated: ' || title ELSE reason END AS detail
          FROM decisions d JOIN flags f USING (flag_id)"""),
    ),
    "feedback_stats": (
        feedback_stats,
        with_(FLAGS + ", " + DECISIONS, """SELECT flag_type, count(*) AS decisions, round(100.0 * count(*) FILTER (decision = 'DISMISS') / count(*), 2)::DOUBLE AS dismissal_rate,
          1.0::DOUBLE AS hours_to_first_decision, count(*) FILTER (decision_id % 2 = 0) AS arrests FROM decisions JOIN flags USING (flag_id) GROUP BY 1"""),
    ),
    "role_projection": (
        role_projection,
        with_(ORDERS, """SELECT incident_id, crime_type, district, occurrence_datetime, 'C' || CAST(offender_id AS VARCHAR) AS offender_id, round(property_loss, 6) AS property_loss, status, segment FROM inc
          JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = incident_id"""),
    ),
    "constable_flags": (constable_flags, with_(FLAGS, "SELECT flag_id, severity, status FROM flags WHERE jurisdiction_id = 'S7' OR target_id = 'S7'")),
    "sp_flags": (sp_flags, with_(FLAGS, "SELECT flag_id, severity, status FROM flags WHERE severity IN ('HIGH', 'CRITICAL') OR status = 'ESCALATED'")),
    "map_filter": (
        map_filter,
        with_(FLAGS, "SELECT flag_id, severity, flag_type AS category FROM flags WHERE jurisdiction_id = 'S3' AND severity IN ('HIGH', 'CRITICAL') AND flag_type IN ('HOTSPOT', 'ANOMALY')"),
    ),
    "recent_incidents": (
        recent_incidents,
        with_(EVENTS, "SELECT incident_id, occurrence_datetime FROM inc WHERE district = 'D4' AND occurrence_datetime >= (SELECT max(occurrence_datetime) FROM inc) - INTERVAL 7 DAY"),
    ),
    "station_backlog": (
        lambda s, d: shaped(views.station_backlog(inputs.event_incidents(s, d))),
        with_(EVENTS, """SELECT police_station, count(*) AS total_station_cases, count(*) FILTER (status IN ('OPEN', 'UNDER_INVESTIGATION')) AS open_cases,
          count(*) FILTER (status NOT IN ('OPEN', 'UNDER_INVESTIGATION')) AS closed_cases,
          CAST(round(100.0 * count(*) FILTER (status IN ('OPEN', 'UNDER_INVESTIGATION')) / count(*)) AS BIGINT) AS backlog_rate_pct FROM inc GROUP BY 1"""),
    ),
    "station_comparison": (
        lambda s, d: shaped(views.station_comparison(inputs.event_incidents(s, d).withColumn("police_station", F.when(F.col("incident_id") % 9 != 0, F.col("police_station"))))),
        with_(EVENTS, """SELECT coalesce(CASE WHEN incident_id % 9 <> 0 THEN police_station END, 'UNKNOWN') AS police_station, count(*) AS total_incidents,
          count(*) FILTER (status = 'OPEN') AS open_cases FROM inc GROUP BY 1"""),
    ),
    "district_metrics": (
        lambda s, d: shaped(views.district_metrics(inputs.geo_incidents(s, d))),
        with_(GEO + ", c AS (SELECT district, police_station, round(latitude * 100) AS y, round(longitude * 100) AS x FROM geo GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)",
              """SELECT district, count(*) AS total_district_incidents, coalesce(any_value(h), 0) AS active_hotspots_count FROM inc
              LEFT JOIN (SELECT district, count(*) AS h FROM c GROUP BY 1) USING (district) GROUP BY district"""),
    ),
    "analyst_overview": (
        lambda s, d: shaped(views.analyst_overview(inputs.event_incidents(s, d), inputs.event_flags(s, d), inputs.order_victims(s, d))),
        """SELECT (SELECT count(*) FROM events) AS total_state_incidents, (SELECT count(*) FROM events) AS total_active_flags,
          (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) AS cross_district_links_count""",
    ),
    "surfaced_anomalies": (
        lambda s, d: shaped(filters.surfaced_anomalies(inputs.event_flags(s, d)).select("flag_id", "flag_type")),
        with_(FLAGS, "SELECT flag_id, flag_type FROM flags WHERE flag_type IN ('ANOMALY', 'EMERGING_TREND')"),
    ),
    "top_concerns": (
        lambda s, d: shaped(views.top_concerns(inputs.event_flags(s, d)).select("flag_id", "severity", "confidence_score")),
        with_(FLAGS, """SELECT flag_id, severity, round(confidence_score, 6) AS confidence_score FROM flags WHERE severity IN ('CRITICAL', 'HIGH')
          ORDER BY CASE WHEN status = 'PENDING' THEN 0 ELSE 1 END, CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, confidence_score DESC, flag_id LIMIT 5"""),
    ),
    "brief_counts": (
        lambda s, d: shaped(views.brief_counts(inputs.event_incidents(s, d), inputs.event_flags(s, d))),
        with_(FLAGS, """SELECT (SELECT count(*) FROM events) AS total_firs, count(*) FILTER (status = 'PENDING') AS pending_flags, count(*) FILTER (status = 'ESCALATED') AS escalated_flags,
          count(*) FILTER (status IN ('PENDING', 'ESCALATED')) AS active_flags FROM flags"""),
    ),
    "top_flagged": (
        lambda s, d: shaped(views.top_flagged(inputs.event_flags(s, d))),
        with_(FLAGS, "SELECT jurisdiction_id, count(*) AS flags FROM flags WHERE status IN ('PENDING', 'ESCALATED') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    ),
    "oldest_unreviewed": (
        lambda s, d: shaped(views.oldest_unreviewed(inputs.event_flags(s, d), _now())),
        with_(FLAGS, "SELECT DATE '2024-02-01' - CAST(min(created_at) AS DATE) AS oldest_pending_days FROM flags WHERE status = 'PENDING'"),
    ),
    "period_comparison": (
        lambda s, d: shaped(views.period_comparison(inputs.order_incidents(s, d), F.lit("1998-06-15").cast("timestamp"))),
        with_(ORDERS, """, m AS (SELECT count(*) FILTER (date_trunc('month', occurrence_datetime) = DATE '1998-06-01') AS c,
          count(*) FILTER (date_trunc('month', occurrence_datetime) = DATE '1998-05-01') AS p FROM inc)
          SELECT c AS current_month, p AS previous_month, round(100.0 * (c - p) / nullif(p, 0)::DOUBLE, 1) AS change_pct FROM m"""),
    ),
    "dashboard_stats": (
        dashboard_stats,
        with_(GEO + """, n AS (SELECT CAST(max(occurrence_datetime) AS DATE) AS t FROM inc), d AS (SELECT *, CAST(occurrence_datetime AS DATE) AS day FROM inc CROSS JOIN n),
          s AS (SELECT count(*) AS n FROM (SELECT 1 FROM geo GROUP BY police_station, round(latitude * 100), round(longitude * 100) HAVING count(*) >= 3)),
          m AS (SELECT count(*) FILTER (day >= date_trunc('month', t)) AS c, count(*) FILTER (day < date_trunc('month', t) AND day >= date_trunc('month', t) - INTERVAL 1 MONTH) AS p FROM d)""",
          """SELECT count(*) AS total_incidents, count(*) FILTER (incident_id % 4 = 0) AS pending_flags, (SELECT n FROM s) AS active_hotspots,
          round(100.0 * count(*) FILTER (status = 'CLOSED') / count(*), 2)::DOUBLE AS closure_rate, round(avg(k), 2) AS avg_response_hours,
          count(*) FILTER (day = t) AS incidents_today, count(*) FILTER (day >= date_trunc('week', t)) AS incidents_this_week,
          (SELECT c FROM m) AS incidents_this_month, (SELECT round(100.0 * (c - p) / nullif(p, 0)::DOUBLE, 1) FROM m) AS change_from_last_month FROM d"""),
    ),
    "category_series": (
        category_series,
        with_(EVENTS, "SELECT CAST(occurrence_datetime AS DATE) AS date, count(*) AS total, " + ", ".join(
            f"count(*) FILTER (crime_type = '{k}') AS {k.lower()}" for k in ("Assault", "Burglary", "Fraud", "Robbery", "Theft")) + " FROM inc GROUP BY 1"),
    ),
    "top_types": (
        lambda s, d: shaped(views.top_types(inputs.order_incidents(s, d))),
        with_(ORDERS, """SELECT * FROM (SELECT district, crime_type, count(*) AS n, row_number() OVER (PARTITION BY district ORDER BY count(*) DESC, crime_type) AS rank
          FROM inc GROUP BY 1, 2) WHERE rank <= 3"""),
    ),
    "dataset_statistics": (
        lambda s, d: shaped(views.dataset_statistics(inputs.order_incidents(s, d))),
        with_(ORDERS, """SELECT count(*) AS total_incidents, min(occurrence_datetime) AS first_incident, max(occurrence_datetime) AS last_incident,
          count(DISTINCT district) AS districts, count(DISTINCT crime_type) AS crime_types FROM inc"""),
    ),
    "summary_facts": (
        summary_facts,
        with_(ORDERS + ", " + TREND + """, perday AS (SELECT district, date, sum(daily_incidents) AS n FROM grid GROUP BY 1, 2),
          r AS (SELECT district, sum(n) AS t, round(avg(n), 3) AS a FROM perday GROUP BY 1)""",
          """SELECT 'largest_cluster' AS fact, (SELECT CAST(offender_id AS VARCHAR) FROM inc GROUP BY offender_id ORDER BY count(*) DESC, offender_id LIMIT 1) AS value
          UNION ALL SELECT 'largest_spike', CAST(max(peak_incident_count) AS VARCHAR) FROM spikes
          UNION ALL SELECT 'most_affected_district', (SELECT district FROM r ORDER BY t DESC, district LIMIT 1)
          UNION ALL SELECT 'most_common_crime', (SELECT crime_type FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
          UNION ALL SELECT 'highest_risk_district', (SELECT district FROM r ORDER BY a DESC, district LIMIT 1)
          UNION ALL SELECT 'lowest_risk_district', (SELECT district FROM r ORDER BY a, district LIMIT 1)"""),
    ),
}
