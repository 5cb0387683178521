"""Registered queries: keyed tables, documents, cache and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators.scale import shared_folder
from ...sources import cache, readers, store
from ...streaming import counts, enrich, tables
from .. import inputs
from .common import DECISIONS, EVENTS, FLAGS, GEO, shaped, with_

_NOW = "2024-02-01 00:00:00"


def latest_rows(spark, d):
    newest = store.latest_rows(inputs.event_decisions(spark, d), ["flag_id"], "created_at", "decision_id")
    return shaped(newest.select("decision_id", "flag_id", "reviewer_id", "decision", "created_at"))


def patched_rows(spark, d):
    flags = inputs.event_flags(spark, d).withColumn("updated_at", F.col("created_at"))
    change = inputs.event_decisions(spark, d).where("decision = 'DISMISS'").groupBy("flag_id").agg(F.lit("DISMISSED").alias("status"), F.lit(None).cast("string").alias("title"))
    out = store.patched(flags, change, "flag_id", F.lit(_NOW).cast("timestamp_ntz"))
    return shaped(out.select("flag_id", "status", "title", "updated_at"))


def upsert_nodes(spark, d):
    e = inputs.event_incidents(spark, d)
    rows = store.node_rows(e, F.lit("offender"), F.col("offender_id"), F.concat(F.lit("case "), F.col("incident_id").cast("string")), F.col("occurrence_datetime"))
    early = rows.where(F.col("updated_at") < F.lit("2024-01-15").cast("timestamp_ntz"))
    late = rows.where(F.col("updated_at") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return shaped(store.upsert_nodes(early, late))


def upsert_edges(spark, d):
    """Every line of an order writes the order's edge to its supplier again."""
    l = inputs.table(spark, d, "lineitem")
    rows = store.edge_rows(
        l, F.col("l_orderkey"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit("victim_of"), F.col("l_shipdate")
    )
    early = rows.where(F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = rows.where(F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return shaped(store.upsert_edges(early, late))


def cross_incident_edges(spark, d):
    l = inputs.table(spark, d, "lineitem").join(inputs.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = store.edge_rows(
        l, F.col("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit("TARGETED"), F.col("o_orderdate")
    )
    return shaped(store.cross_incident_edges(rows))


def cache_merge(spark, d):
    """Station totals cached, patched with the open cases, and read back."""
    e = inputs.event_incidents(spark, d)
    now = F.lit(_NOW).cast("timestamp")
    totals = e.groupBy("police_station").agg(F.count(F.lit(1)).alias("total"), F.lit("old").alias("state"))
    key = cache.dashboard_key(F.lit("sho"), F.col("police_station"))
    first = cache.entries(totals, key, F.to_json(F.struct("total", "state")), now)
    opened = e.groupBy("police_station").agg(F.count_if(F.col("status") == "OPEN").alias("open"))
    change = opened.select(key.alias("cache_key"), F.to_json(F.struct("open", F.lit("new").alias("state"))).alias("payload"))
    later = now + F.make_dt_interval(secs=F.lit(60))
    live = cache.get(cache.put(first, cache.patch(first, change, later)), later)
    return shaped(
        live.select(
            "cache_key", F.get_json_object("payload", "$.total").cast("bigint").alias("total"), F.get_json_object("payload", "$.open").cast("bigint").alias("open"),
            F.get_json_object("payload", "$.state").alias("state"),
        )
    )


def flatten_documents(spark, d):
    flat = readers.flatten_cases(inputs.case_documents(spark, d))
    return shaped(flat.select("incident_id", "case_no", "district", "police_station", "occurrence_datetime", "reported_datetime", "mo_tags", "offender_id", "prior_record_flag"))


def _stream(spark, d):
    schema = inputs.table(spark, d, "events").schema
    raw = tables.file_stream(spark, d, schema, "events.parquet")
    return inputs.incidents_of_events(raw)


def _slices(spark, d, folder):
    """All events in four files, taken two at a time; every file spans the whole time, so later batches bring earlier days."""
    inputs.table(spark, d, "events").repartition(4, F.col("event_id") % 7).write.parquet(f"{folder}/source")
    raw = tables.file_stream(spark, f"{folder}/source", inputs.table(spark, d, "events").schema, files_per_batch=2)
    return inputs.incidents_of_events(raw)


def _run_folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/caseweave/{uuid.uuid4().hex}"


def streamed_daily_counts(spark, d):
    folder = _run_folder(spark)
    counts.run_daily_counts(_slices(spark, d, folder), f"{folder}/tables", f"{folder}/checkpoint")
    return shaped(counts.current_counts(spark, f"{folder}/tables"))


def streamed_edges(spark, d):
    folder = _run_folder(spark)
    enrich.run_enrichment(inputs.with_coordinates(_slices(spark, d, folder)), f"{folder}/tables", f"{folder}/checkpoint")
    edges = enrich.current_edges(spark, f"{folder}/tables")
    return shaped(edges.select("from_node_id", "to_node_id", "relation_type", "incident_id", "weight"))


def streamed_nodes(spark, d):
    folder = _run_folder(spark)
    enrich.run_enrichment(inputs.with_coordinates(_slices(spark, d, folder)), f"{folder}/tables", f"{folder}/checkpoint")
    return shaped(enrich.current_nodes(spark, f"{folder}/tables").select("node_id", "node_type", "ref_id", "display_name"))


def streamed_flags(spark, d):
    folder = _run_folder(spark)
    enrich.run_enrichment(inputs.with_coordinates(_stream(spark, d)), f"{folder}/tables", f"{folder}/checkpoint")
    found = tables.read_all(spark, f"{folder}/tables", "flags")
    return shaped(found.select("flag_id", "flag_type", "severity", "confidence_score", "target_id", "jurisdiction_id", "status"))


QUERIES = {
    "latest_rows": (
        latest_rows,
        with_(DECISIONS, """SELECT decision_id, flag_id, reviewer_id, decision, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY flag_id ORDER BY created_at DESC, decision_id DESC) AS r FROM decisions) WHERE r = 1"""),
    ),
    "patched_rows": (
        patched_rows,
        with_(FLAGS + ", " + DECISIONS, f"""SELECT flag_id, 'DISMISSED' AS status, title, TIMESTAMP '{_NOW}' AS updated_at FROM flags
          WHERE flag_id IN (SELECT flag_id FROM decisions WHERE decision = 'DISMISS')"""),
    ),
    "upsert_nodes": (
        upsert_nodes,
        with_(EVENTS, """SELECT 'offender_' || CAST(offender_id AS VARCHAR) AS node_id, 'offender' AS node_type, CAST(offender_id AS VARCHAR) AS ref_id,
          'case ' || CAST(arg_max(incident_id, occurrence_datetime) AS VARCHAR) AS display_name, min(occurrence_datetime) AS created_at, max(occurrence_datetime) AS updated_at
          FROM inc GROUP BY offender_id"""),
    ),
    "upsert_edges": (
        upsert_edges,
        """SELECT 'edge_' || l_orderkey || '_o' || l_orderkey || '_s' || l_suppkey AS edge_id, 'o' || l_orderkey AS from_node_id, 's' || l_suppkey AS to_node_id,
          'victim_of' AS relation_type, CAST(l_orderkey AS VARCHAR) AS incident_id, count(*)::DOUBLE AS weight, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    ),
    "cross_incident_edges": (
        cross_incident_edges,
        """SELECT 'c' || o_custkey AS from_node_id, 's' || l_suppkey AS to_node_id, 'TARGETED' AS relation_type, count(DISTINCT l_orderkey) AS weight, min(o_orderdate) AS created_at
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
    ),
    "cache_merge": (
        cache_merge,
        with_(EVENTS, """SELECT 'dashboard_summary:sho:' || police_station AS cache_key, count(*) AS total, count(*) FILTER (status = 'OPEN') AS "open", 'new' AS state FROM inc GROUP BY police_station"""),
    ),
    "flatten_documents": (
        flatten_documents,
        """SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, 'CN-' || o_orderkey AS case_no, o_orderpriority AS district, o_orderstatus AS police_station, o_orderdate AS occurrence_datetime,
          o_orderdate + INTERVAL 30 HOUR AS reported_datetime, replace(o_orderpriority, '-', ',') AS mo_tags, CAST(o_custkey AS VARCHAR) AS offender_id, o_totalprice > 200000 AS prior_record_flag
          FROM orders""",
    ),
    "case_sections": (
        lambda s, d: shaped(readers.case_sections(inputs.case_documents(s, d)).select("incident_id", "ActID", "SectionID", "ActOrderID")),
        """SELECT CAST(l_orderkey AS VARCHAR) AS incident_id, l_returnflag AS "ActID", CAST(l_partkey AS VARCHAR) AS "SectionID", CAST(l_linenumber AS BIGINT) AS "ActOrderID"
          FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    ),
    "streamed_daily_counts": (
        streamed_daily_counts,
        with_(EVENTS, "SELECT CAST(occurrence_datetime AS DATE) AS date, district, crime_type, count(*) AS daily_incidents FROM inc GROUP BY 1, 2, 3"),
    ),
    "streamed_edges": (
        streamed_edges,
        with_(EVENTS, """SELECT 'offender_' || CAST(offender_id AS VARCHAR) AS from_node_id, 'LOC::' || district || '::' || police_station AS to_node_id, 'occurred_at' AS relation_type,
          CAST(incident_id AS VARCHAR) AS incident_id, 1.0::DOUBLE AS weight FROM inc"""),
    ),
    "streamed_nodes": (
        streamed_nodes,
        with_(EVENTS, """SELECT DISTINCT 'offender_' || CAST(offender_id AS VARCHAR) AS node_id, 'offender' AS node_type, CAST(offender_id AS VARCHAR) AS ref_id, CAST(offender_id AS VARCHAR) AS display_name FROM inc
          UNION ALL SELECT DISTINCT 'LOC::' || district || '::' || police_station, 'location', 'LOC::' || district || '::' || police_station, 'LOC::' || district || '::' || police_station FROM inc"""),
    ),
    "streamed_flags": (
        streamed_flags,
        with_(GEO + """, c AS (SELECT police_station, CAST(round(latitude * 100) AS BIGINT) AS y, CAST(round(longitude * 100) AS BIGINT) AS x, count(*) AS n FROM geo GROUP BY 1, 2, 3),
          s AS (SELECT printf('HS_%s_%.2f_%.2f', police_station, y / 100.0, x / 100.0) AS id, police_station, round(least(1.0, 0.4 + n * 0.1), 2)::DOUBLE AS score FROM c WHERE n >= 3),
          aged AS (SELECT *, CAST((SELECT max(occurrence_datetime) FROM inc) AS DATE) - CAST(occurrence_datetime AS DATE) AS age FROM inc),
          t AS (SELECT crime_type, count(*) FILTER (age < 30) AS n, count(*) FILTER (age >= 30) / 3.0 AS b FROM aged WHERE age < 120 GROUP BY 1)""",
          """SELECT 'FLAG_HS_' || id || '@0' AS flag_id, 'HOTSPOT' AS flag_type, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
            score AS confidence_score, id AS target_id, police_station AS jurisdiction_id, 'PENDING' AS status FROM s
          UNION ALL SELECT 'FLAG_TREND_ALL_' || crime_type || '@0', 'EMERGING_TREND', 'HIGH', 0.88, crime_type, 'ALL', 'PENDING' FROM t WHERE 100 * (n - b) / nullif(b, 0) >= 50"""),
    ),
}
