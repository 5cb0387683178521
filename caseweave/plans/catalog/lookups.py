"""Registered queries: lookups on stored edges and sketches, the run summary and its facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...functions import texts
from ...operators import adjacency, dbscan, filters, graph, hotspots, risk, sketches, trend, views
from ...operators.scale import materialize, shared_folder
from ...sources import readers
from .. import batch, inputs
from . import networks, scores
from .common import CLUSTER_STATS, EVENTS, ORDERS, TREND, shaped, with_
from .networks import _EDGES, _NODES


def _stored(spark, d):
    nodes, edges = networks._event_graph(spark, d)
    return nodes, adjacency.store_adjacency(edges, 8)


def adjacent_hops(spark, d):
    nodes, name = _stored(spark, d)
    return shaped(adjacency.k_hop(spark, name, networks._start(nodes), 2)[0])


def adjacent_hop_edges(spark, d):
    nodes, name = _stored(spark, d)
    return shaped(adjacency.k_hop(spark, name, networks._start(nodes), 2)[1])


def edges_of_stations(spark, d):
    """Edges that touch one of the ten first locations, read from their buckets."""
    nodes, name = _stored(spark, d)
    wanted = nodes.where("type = 'location'").orderBy("id").limit(10).select("id")
    return shaped(adjacency.edges_of(spark, name, wanted, "occurred_at"))


def incident_edges(spark, d):
    """The edges of the newest incident and the nodes they touch."""
    nodes, edges = networks._event_graph(spark, d)
    newest = inputs.event_incidents(spark, d).orderBy(F.col("occurrence_datetime").desc(), F.col("incident_id").desc()).first()
    ends, own = graph.incident_subgraph(nodes, edges, str(newest["incident_id"]))
    return shaped(own.select("source", "target", "relation").unionByName(ends.select(F.col("id").alias("source"), F.col("type").alias("target"), F.lit("node").alias("relation"))))


def resolved_nodes(spark, d):
    """Nodes of incident ids, half of which do not exist."""
    nodes, _ = networks._event_graph(spark, d)
    e = inputs.event_incidents(spark, d)
    ids = e.select(F.explode(F.array(F.col("incident_id").cast("string"), F.concat(F.lit("no"), F.col("incident_id")))).alias("id"))
    return shaped(graph.resolve_nodes(nodes, ids).select("id", "type", "label"))


def relation_subset(spark, d):
    cases, victims = inputs.order_case_graph(spark, d)
    return shaped(filters.relation_edges(graph.graph_edges(cases, victim_links=victims), "victim_of").select("source", "target"))


def node_ages(spark, d):
    """Ages of people nodes from a table of people; others have none."""
    cases, _ = inputs.order_case_graph(spark, d)
    ages = inputs.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") % 60 + 18).alias("age"))
    return shaped(graph.graph_nodes(cases, offender_ages=ages).select("id", "type", "age"))


def live_incidents(spark, d):
    """Live records under their own column names, without an event time and without a district column."""
    e = inputs.event_incidents(spark, d)
    live = e.select(F.col("incident_id").alias("fir_number"), F.col("crime_type").alias("case_type"), F.col("police_station").alias("station_id"), F.col("occurrence_datetime").alias("created_at"))
    return shaped(readers.map_live_incidents(live).select("incident_id", "crime_type", "police_station", "district", "occurrence_datetime"))


def spike_texts(spark, d):
    e = inputs.event_incidents(spark, d)
    newest = e.agg(F.max("occurrence_datetime")).scalar()
    found = trend.period_spikes(e, newest, 7, 3, ("district", "crime_type"))
    return shaped(found.select("district", "crime_type", texts.signed_percent(F.col("spike_percentage")).alias("change")))


def status_words(spark, d):
    """Cases per status in plain words, and how many of them are open, over both status vocabularies."""
    rows = inputs.event_incidents(spark, d).select("status").unionByName(inputs.order_incidents(spark, d).select("status"))
    counted = materialize(rows.groupBy("status").agg(F.count(F.lit(1)).alias("cases")))
    opened = filters.open_backlog(counted).select("status", F.lit(True).alias("open"))
    return shaped(counted.join(opened, "status", "left").select(texts.words_of_code(F.col("status")).alias("words"), "cases", F.coalesce("open", F.lit(False)).alias("is_open"), "status"))


def sketched_month(spark, d):
    """The last 30 days of every district from its days' sketches, and whether the estimates are within their errors of the exact figures."""
    e = materialize(inputs.event_incidents(spark, d))
    stored = materialize(sketches.daily_sketches(e))
    newest = F.to_date(e.agg(F.max("occurrence_datetime")).scalar())
    recent = lambda c: (F.datediff(newest, c) >= 0) & (F.datediff(newest, c) < 30)
    found = sketches.estimates(sketches.merged(stored.where(recent("date")), "district"))
    below = [F.count_if(F.col("property_loss") < F.col("quantiles")[i]) / F.count("property_loss") for i in range(3)]
    upto = [F.count_if(F.col("property_loss") <= F.col("quantiles")[i]) / F.count("property_loss") for i in range(3)]
    exact = e.where(recent("occurrence_datetime")).join(found.select("district", "quantiles"), "district").groupBy("district").agg(
        F.count_distinct("offender_id").alias("people"), *[c.alias(f"lo{i}") for i, c in enumerate(below)], *[c.alias(f"hi{i}") for i, c in enumerate(upto)]
    )
    ranks = F.lit(True)
    for i, p in enumerate((1 / 3, 0.5, 2 / 3)):
        ranks = ranks & (F.col(f"lo{i}") - 0.02 <= p) & (F.col(f"hi{i}") + 0.02 >= p)
    near = F.abs(F.col("distinct_people") - F.col("people")) <= F.greatest(F.lit(1.0), 0.06 * F.col("people"))
    return shaped(found.join(exact, "district").select("district", "sketches", "incidents", near.alias("people_within"), ranks.alias("quantiles_within")))


def batch_summary(spark, d):
    """Every stage of the scoring job over incidents without texts: its status, the class of its error, and the rows of its tables."""
    geo = inputs.with_coordinates(inputs.event_incidents(spark, d)).withColumn("offender_id", F.concat(F.lit("U"), F.col("offender_id").cast("string")))
    _, summary = batch.run_batch(spark, geo, f"{shared_folder(spark).rstrip('/')}/caseweave/{uuid.uuid4().hex}", feature_columns=["property_loss", "status", "crime_type"])
    return shaped(summary.select("module", "status", "error_class", F.explode_outer("tables").alias("t")).select("module", "status", "error_class", F.col("t.name").alias("table_name"), F.col("t.rows").alias("rows")))


def scoring_facts(spark, d):
    """Headline facts of the clusters and of the district scores."""
    clustered = scores._clustered(spark, d)
    geo, stats, *rest = scores._risk_inputs(spark, d, clustered)
    tiered = hotspots.relative_tiers(stats)
    found, _ = risk.risk_scores(geo, stats, *rest)
    return shaped(views.hotspot_facts(dbscan.assignments(clustered[1]), tiered).unionByName(views.score_facts(materialize(found))))


_COUNTED = {
    ("hotspot", "cluster_assignments"): "SELECT count(*) FROM inc", ("hotspot", "cluster_stats"): "SELECT count(*) FROM cluster_stats",
    ("trend", "trend_summary"): "SELECT count(*) FROM summary", ("trend", "anomalies"): "SELECT count(*) FROM anomalies", ("trend", "spike_events"): "SELECT count(*) FROM spikes",
    ("trend", "statistics"): "SELECT count(*) FROM statistics", ("trend", "weekly"): "SELECT count(DISTINCT (district, crime_type, date_trunc('week', date))) FROM grid",
    ("trend", "monthly"): "SELECT count(DISTINCT (district, crime_type, last_day(date))) FROM grid", ("trend", "day_of_week"): "SELECT count(DISTINCT dayname(date)) FROM grid",
    ("trend", "district_ranking"): "SELECT count(DISTINCT district) FROM grid", ("graph", "graph_edges"): "SELECT 2 * count(*) FROM inc",
    ("graph", "graph_nodes"): "SELECT count(*) + count(DISTINCT (district, police_station)) + count(DISTINCT offender_id) FROM inc",
    ("anomaly", "incident_anomalies"): "SELECT count(*) FROM inc", ("risk", "risk_scores"): "SELECT count(DISTINCT district) FROM inc",
    ("risk", "risk_feature_importance"): f"SELECT {len(risk.WEIGHTS)}",
}
_SUMMARY_SQL = "\nUNION ALL ".join(
    [f"SELECT '{m}' AS module, 'success' AS status, CAST(NULL AS VARCHAR) AS error_class, '{t}' AS table_name, CAST(({q}) AS BIGINT) AS rows" for (m, t), q in _COUNTED.items()]
    + ["SELECT 'similarity', 'failed', 'InputError', NULL, NULL", "SELECT 'final', 'partial_success', NULL, NULL, NULL"]
)


def _facts(pairs: dict[str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{fact}' AS fact, CAST(({q}) AS VARCHAR) AS value" for fact, q in pairs.items())


_FACTS_SQL = _facts({
    "incidents": "SELECT count(*) FROM clustered", "noise": "SELECT count(*) FROM clustered WHERE cluster_id = -1", "clusters": "SELECT count(*) FROM tiers",
    "mean_cluster_size": "SELECT round(avg(number_of_incidents), 2) FROM tiers", "largest_cluster_size": "SELECT max(number_of_incidents) FROM tiers",
    **{f"{v.lower()}_clusters": f"SELECT count(*) FROM tiers WHERE risk_level = '{v}'" for v in ("High", "Medium", "Low")},
    **{f"largest_cluster_{a}": f"SELECT {c} FROM tiers ORDER BY number_of_incidents DESC, cluster_id LIMIT 1" for c, a in (("cluster_id", "id"), ("district", "district"), ("risk_level", "level"))},
    "districts": "SELECT count(*) FROM l", "mean_score": "SELECT round(avg(risk_score), 2) FROM l", "highest_score": "SELECT max(risk_score) FROM l", "lowest_score": "SELECT min(risk_score) FROM l",
    "lowest_risk_district": "SELECT district FROM l ORDER BY risk_score, district LIMIT 1",
    **{f"{v}_districts": f"SELECT count(*) FROM l WHERE level = '{v}'" for v in ("low", "moderate", "high", "critical")},
})

QUERIES = {
    "adjacent_hops": (adjacent_hops, networks.QUERIES["k_hop"][1]),
    "adjacent_hop_edges": (adjacent_hop_edges, networks.QUERIES["k_hop_edges"][1]),
    "edges_of_stations": (
        edges_of_stations,
        with_(EVENTS + ", " + _EDGES, """SELECT source, target, relation, CAST(weight AS BIGINT) AS weight FROM edges WHERE relation = 'occurred_at'
          AND target IN (SELECT DISTINCT target FROM edges WHERE relation = 'occurred_at' ORDER BY 1 LIMIT 10)"""),
    ),
    "incident_edges": (
        incident_edges,
        with_(EVENTS + ", " + _EDGES + ", " + _NODES + """, one AS (SELECT CAST(incident_id AS VARCHAR) AS id FROM inc ORDER BY occurrence_datetime DESC, incident_id DESC LIMIT 1),
          own AS (SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM one))""",
          """SELECT * FROM own UNION ALL SELECT id, type, 'node' FROM nodes WHERE id IN (SELECT source FROM own UNION SELECT target FROM own)"""),
    ),
    "resolved_nodes": (resolved_nodes, with_(EVENTS, "SELECT CAST(incident_id AS VARCHAR) AS id, 'incident' AS type, 'Incident ' || incident_id AS label FROM inc")),
    "relation_subset": (relation_subset, with_(ORDERS, "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source, 'V' || CAST(l_suppkey AS VARCHAR) AS target FROM lineitem JOIN inc ON l_orderkey = incident_id")),
    "node_ages": (
        node_ages,
        with_(ORDERS, """SELECT CAST(incident_id AS VARCHAR) AS id, 'incident' AS type, CAST(NULL AS BIGINT) AS age FROM inc
          UNION ALL SELECT DISTINCT 'LOC::' || district, 'location', NULL FROM inc UNION ALL SELECT DISTINCT 'C' || offender_id, 'offender', offender_id % 60 + 18 FROM inc"""),
    ),
    "live_incidents": (live_incidents, with_(EVENTS, "SELECT incident_id, crime_type, police_station, 'UNKNOWN' AS district, occurrence_datetime FROM inc")),
    "spike_texts": (
        spike_texts,
        with_(EVENTS + """, aged AS (SELECT *, CAST((SELECT max(occurrence_datetime) FROM inc) AS DATE) - CAST(occurrence_datetime AS DATE) AS age FROM inc),
          c AS (SELECT district, crime_type, count(*) FILTER (age < 7) AS n, (count(*) FILTER (age >= 7) / 3.0)::DOUBLE AS b FROM aged WHERE age >= 0 AND age < 28 GROUP BY 1, 2),
          p AS (SELECT district, crime_type, round(100.0 * (n - b) / nullif(b, 0), 1) AS p FROM c)""",
          "SELECT district, crime_type, CASE WHEN p > 0 THEN '+' ELSE '' END || printf('%.1f', p) || '%' AS change FROM p"),
    ),
    "status_words": (
        status_words,
        """WITH s AS (SELECT CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'UNDER_INVESTIGATION' ELSE 'CLOSED' END AS status FROM events
          UNION ALL SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'under_review' WHEN 'F' THEN 'closed' END FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
        SELECT lower(replace(status, '_', ' ')) AS words, count(*) AS cases, upper(status) <> 'CLOSED' AS is_open, status FROM s GROUP BY status""",
    ),
    "sketched_month": (
        sketched_month,
        with_(EVENTS + ", aged AS (SELECT *, CAST(occurrence_datetime AS DATE) AS day, CAST((SELECT max(occurrence_datetime) FROM inc) AS DATE) - CAST(occurrence_datetime AS DATE) AS age FROM inc)",
              "SELECT district, count(DISTINCT day) AS sketches, count(*) AS incidents, true AS people_within, true AS quantiles_within FROM aged WHERE age BETWEEN 0 AND 29 GROUP BY district"),
    ),
    "batch_summary": (batch_summary, with_(CLUSTER_STATS + ", " + TREND, _SUMMARY_SQL, True)),
    "scoring_facts": (scoring_facts, with_(scores._RISK + scores._NORMAL + f", l AS ({scores._LEVELS})", _FACTS_SQL, True)),
}
