"""Role views, the executive brief, vocabulary checks and file round trips.

A view is a set of tables; its query lists them as rows (part, item, value).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...operators import flags as flag_ops
from ...operators import filters, quality, trend, views
from ...operators.scale import shared_folder
from ...sources import readers, writers
from .. import inputs
from .common import EVENTS, FLAGS, GEO, ORDERS, shaped, with_
from .reviews import _NOW, _SPOTS, _newest, _now

STATION, DISTRICT = "S7", "D3"


def _rows(view: dict[str, DataFrame], parts: dict[str, tuple[str, str]]) -> DataFrame:
    """(part, item, value) of the named tables; ``parts`` has the item and the value expression of each."""
    out: DataFrame | None = None
    for part, (item, value) in parts.items():
        rows = view[part].select(F.lit(part).alias("part"), F.expr(f"cast({item} as string)").alias("item"), F.expr(f"cast({value} as double)").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return shaped(out)


def _sql(ctes: str, parts: dict[str, str]) -> str:
    """The twin: each part is ``item, value FROM ...``."""
    chosen = (f"SELECT '{p}' AS part, CAST(item AS VARCHAR) AS item, round(CAST(value AS DOUBLE), 6) AS value FROM ({q})" for p, q in parts.items())
    return with_(ctes, "\nUNION ALL ".join(chosen))


def _people(spark, d) -> DataFrame:
    """Customers as people; those with a balance have a prior record."""
    c = inputs.table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("offender_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("risk_tier"), F.lit(None).cast("string").alias("vehicle_no"),
        F.lit(1).alias("prior_cases_count"), (F.col("c_acctbal") > 0).alias("prior_record_flag"),
    )


def _links(spark, d) -> DataFrame:
    pairs = inputs.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"))
    return pairs.agg(F.count(F.lit(1)).alias("weight"))


def constable_view(spark, d):
    view = views.constable_view(inputs.geo_incidents(spark, d), inputs.event_flags(spark, d), _people(spark, d), STATION)
    return _rows(view, {
        "active_beat_flags": ("flag_id", "confidence_score"), "patrol_route_hotspots": ("hotspot_id", "incident_count"),
        "totals": ("'all'", "total_incidents"), "repeat_offenders_nearby": ("offender_id", "prior_cases_count"),
    })


def sho_view(spark, d):
    view = views.sho_view(inputs.geo_incidents(spark, d), inputs.event_flags(spark, d), _links(spark, d), STATION)
    return _rows(view, {
        "case_backlog_summary": ("police_station", "open_cases"), "local_hotspots": ("hotspot_id", "incident_count"), "pending_flags": ("flag_id", "confidence_score"),
        "suspect_network_links": ("concat_ws('>', source, target)", "weight"), "recent_firs": ("incident_id", "1"),
    })


def sp_view(spark, d):
    geo = inputs.geo_incidents(spark, d)
    view = views.sp_view(geo, inputs.event_flags(spark, d), trend.period_spikes(geo, _newest(geo), 7, 3), DISTRICT)
    return _rows(view, {
        "district_metrics": ("district", "total_district_incidents"), "station_performance_breakdown": ("police_station", "open_cases"),
        "escalated_anomaly_flags": ("flag_id", "confidence_score"), "trend_analysis": ("crime_type", "spike_percentage"),
    })


def analyst_view(spark, d):
    nodes = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    view = views.analyst_view(inputs.geo_incidents(spark, d), inputs.event_flags(spark, d), nodes, _links(spark, d))
    return _rows(view, {
        "statewide_overview": ("total_active_flags", "cross_district_links_count"), "nodes": ("id", "1"), "edges": ("concat_ws('>', source, target)", "weight"),
        "all_surfaced_hotspots": ("hotspot_id", "incident_count"), "surfaced_anomalies": ("flag_id", "confidence_score"),
    })


def dgp_view(spark, d):
    view = views.dgp_view(inputs.geo_incidents(spark, d), inputs.event_flags(spark, d))
    return _rows(view, {
        "top_5_emerging_concerns": ("flag_id", "confidence_score"), "statewide_kpis": ("total_firs_registered", "resolution_rate_pct"), "bottleneck_stations": ("police_station", "open_cases"),
    })


def executive_brief(spark, d):
    view = views.executive_brief(inputs.geo_incidents(spark, d), inputs.event_flags(spark, d), _now(), DISTRICT)
    return _rows(view, {
        "counts": ("total_firs", "active_flags"), "top_flagged": ("jurisdiction_id", "flags"), "period": ("current_month", "previous_month"), "oldest": ("'days'", "oldest_pending_days"),
    })


def enum_report(spark, d):
    """Rows that break a column's vocabulary, per rule: stored flags, raised flags, decisions and incidents."""
    geo = inputs.geo_incidents(spark, d)
    raised = flag_ops.trend_flags(trend.period_spikes(geo, _newest(geo), 7, 3), _now(), minimum=-1000.0)
    rules = quality.enum_rules()
    checked = {
        "flags.flag_type": inputs.event_flags(spark, d).select("flag_type").unionByName(raised.select("flag_type")),
        "flags.status": inputs.event_flags(spark, d).select("status").unionByName(raised.select("status")),
        "review_decisions.decision": inputs.event_decisions(spark, d).select("decision"),
        "incidents.status": inputs.order_incidents(spark, d).select("status").unionByName(geo.select("status")),
    }
    counts: Column = F.count_if(F.size("field_errors") > 0).alias("violations")
    out: DataFrame | None = None
    for name, rows in checked.items():
        found = quality.violations(rows, [rules[name]]).agg(counts).select(F.lit(name).alias("rule"), "violations")
        out = found if out is None else out.unionByName(found)
    return shaped(out)


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/caseweave/{uuid.uuid4().hex}"


ROUND = "incident_id string, crime_type string, district string, police_station string, occurrence_datetime timestamp, property_loss double"


def csv_round_trip(spark, d):
    """All incidents written as header CSV and read back with a declared schema."""
    kept = inputs.event_incidents(spark, d).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ROUND.split(", ")])
    path = writers.write_outputs({"incidents": kept, "absent": None}, _folder(spark), "csv")["incidents"]
    back = readers.read_required_csv(spark, path, "incidents", ROUND)
    return shaped(back.withColumn("occurrence_datetime", F.col("occurrence_datetime").cast("timestamp_ntz")))


def json_round_trip(spark, d):
    """All documents written as JSON records and read back."""
    docs = inputs.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"))
    path = writers.write_json(docs, _folder(spark))
    back = readers.read_json_records(spark, path, "doc_id bigint, lang string, source string, n_chars bigint, text string", lines=True)
    return shaped(back.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit("none"))).alias("digest")))


def role_visibility(spark, d):
    """Every role against every pending flag's severity: how many flags it may review."""
    roles = filters.role_matrix(spark).select("role", "alert_review").where("alert_review")
    levels = inputs.event_flags(spark, d).where("status = 'PENDING'").groupBy("severity").agg(F.count(F.lit(1)).alias("flags"))
    return shaped(levels.withColumn("alert_review", F.lit(True)).join(roles, "alert_review").select("role", "severity", "flags"))


_FLAGS_OF_STATION = f"SELECT flag_id AS item, confidence_score AS value FROM flags WHERE jurisdiction_id = '{STATION}' OR target_id = '{STATION}'"
_SPOTS_OF_STATION = f"SELECT id AS item, n AS value FROM spots WHERE police_station = '{STATION}'"
_OPEN = "status IN ('OPEN', 'UNDER_INVESTIGATION')"
_LINKS = "SELECT CAST(l_orderkey AS VARCHAR) || '>' || CAST(l_suppkey AS VARCHAR) AS item, count(*) AS value FROM lineitem GROUP BY l_orderkey, l_suppkey"
_BOTH = FLAGS + ", " + GEO + _SPOTS

QUERIES = {
    "constable_view": (constable_view, _sql(_BOTH, {
        "active_beat_flags": _FLAGS_OF_STATION, "patrol_route_hotspots": _SPOTS_OF_STATION,
        "totals": f"SELECT 'all' AS item, count(*) AS value FROM inc WHERE police_station = '{STATION}'",
        "repeat_offenders_nearby": "SELECT c_custkey AS item, 1 AS value FROM customer WHERE c_acctbal > 0",
    })),
    "sho_view": (sho_view, _sql(_BOTH, {
        "case_backlog_summary": f"SELECT police_station AS item, count(*) FILTER ({_OPEN}) AS value FROM inc WHERE police_station = '{STATION}' GROUP BY 1",
        "local_hotspots": _SPOTS_OF_STATION, "pending_flags": _FLAGS_OF_STATION, "suspect_network_links": _LINKS + " ORDER BY count(*) DESC, l_orderkey, l_suppkey LIMIT 10",
        "recent_firs": f"SELECT incident_id AS item, 1 AS value FROM inc WHERE police_station = '{STATION}' AND {_OPEN} ORDER BY occurrence_datetime DESC, incident_id LIMIT 15",
    })),
    "sp_view": (sp_view, _sql(_BOTH, {
        "district_metrics": f"SELECT district AS item, count(*) AS value FROM inc WHERE district = '{DISTRICT}' GROUP BY 1",
        "station_performance_breakdown": f"SELECT police_station AS item, count(*) FILTER (status = 'OPEN') AS value FROM inc WHERE district = '{DISTRICT}' GROUP BY 1",
        "escalated_anomaly_flags": "SELECT flag_id AS item, confidence_score AS value FROM flags WHERE severity IN ('HIGH', 'CRITICAL') OR status = 'ESCALATED'",
        "trend_analysis": "SELECT crime_type AS item, p AS value FROM rated",
    })),
    "analyst_view": (analyst_view, _sql(_BOTH, {
        "statewide_overview": "SELECT count(*) AS item, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) AS value FROM events",
        "nodes": "SELECT c_custkey AS item, 1 AS value FROM customer", "edges": _LINKS, "all_surfaced_hotspots": "SELECT id AS item, n AS value FROM spots",
        "surfaced_anomalies": "SELECT flag_id AS item, confidence_score AS value FROM flags WHERE flag_type IN ('ANOMALY', 'EMERGING_TREND')",
    })),
    "dgp_view": (dgp_view, _sql(_BOTH, {
        "top_5_emerging_concerns": """SELECT flag_id AS item, confidence_score AS value FROM flags WHERE severity IN ('CRITICAL', 'HIGH')
          ORDER BY CASE WHEN status = 'PENDING' THEN 0 ELSE 1 END, CASE severity WHEN 'CRITICAL' THEN 0 ELSE 1 END, confidence_score DESC, flag_id LIMIT 5""",
        "statewide_kpis": "SELECT count(*) AS item, round(100.0 * count(*) FILTER (status = 'CLOSED') / count(*), 1) AS value FROM inc",
        "bottleneck_stations": f"SELECT police_station AS item, count(*) FILTER ({_OPEN}) AS value FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    })),
    "executive_brief": (executive_brief, _sql(_BOTH, {
        "counts": f"SELECT (SELECT count(*) FROM inc WHERE district = '{DISTRICT}') AS item, count(*) FILTER (status IN ('PENDING', 'ESCALATED')) AS value FROM flags",
        "top_flagged": "SELECT jurisdiction_id AS item, count(*) AS value FROM flags WHERE status IN ('PENDING', 'ESCALATED') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
        "period": f"""SELECT count(*) FILTER (date_trunc('month', occurrence_datetime) = date_trunc('month', DATE '{_NOW[:10]}')) AS item,
          count(*) FILTER (date_trunc('month', occurrence_datetime) = date_trunc('month', DATE '{_NOW[:10]}') - INTERVAL 1 MONTH) AS value FROM inc WHERE district = '{DISTRICT}'""",
        "oldest": f"SELECT 'days' AS item, DATE '{_NOW[:10]}' - CAST(min(created_at) AS DATE) AS value FROM flags WHERE status = 'PENDING'",
    })),
    "enum_report": (enum_report, with_(FLAGS + ", " + ORDERS, """SELECT 'flags.flag_type' AS rule, count(*) FILTER (lower(flag_type) NOT IN ('hotspot', 'mo_link', 'mo_match', 'emerging_trend', 'anomaly', 'risk_score')) AS violations FROM flags
          UNION ALL SELECT 'flags.status', count(*) FILTER (lower(status) NOT IN ('pending', 'acknowledged', 'escalated', 'dismissed')) FROM flags
          UNION ALL SELECT 'review_decisions.decision', 0
          UNION ALL SELECT 'incidents.status', (SELECT count(*) FILTER (status NOT IN ('open', 'under_review', 'closed')) FROM inc) + (SELECT count(*) FILTER (event_id % 4 = 1) FROM events)""")),
    "csv_round_trip": (csv_round_trip, with_(EVENTS, "SELECT CAST(incident_id AS VARCHAR) AS incident_id, crime_type, district, police_station, occurrence_datetime, round(property_loss, 6) AS property_loss FROM inc")),
    "json_round_trip": (json_round_trip, "SELECT doc_id, lang, source, n_chars, md5(CASE WHEN doc_id % 5 <> 0 THEN text ELSE 'none' END) AS digest FROM documents"),
    "role_visibility": (role_visibility, with_(FLAGS, """SELECT role, severity, count(*) AS flags FROM flags CROSS JOIN (SELECT unnest(['sho', 'sp', 'analyst', 'dgp']) AS role)
          WHERE status = 'PENDING' GROUP BY ALL""")),
}
