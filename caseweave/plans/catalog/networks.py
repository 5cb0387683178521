"""Registered queries: the incident graph and its links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.texts import location_id
from ...operators import graph, linkage
from ...operators.scale import materialize
from .. import inputs
from .common import EVENTS, ORDERS, shaped, with_

_EDGES = """edges AS (
  SELECT CAST(incident_id AS VARCHAR) AS source, 'LOC::' || district || '::' || police_station AS target, 'occurred_at' AS relation, 1 AS weight FROM inc
  UNION ALL SELECT CAST(incident_id AS VARCHAR), 'U' || CAST(offender_id AS VARCHAR), 'involved_in', 1 FROM inc),
ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges),
degree AS (SELECT id, count(*) AS degree FROM ends GROUP BY 1)"""

_ORDER_EDGES = """edges AS (
  SELECT CAST(incident_id AS VARCHAR) AS source, 'LOC::' || district AS target, 'occurred_at' AS relation, 1 AS weight FROM inc
  UNION ALL SELECT CAST(incident_id AS VARCHAR), 'C' || CAST(offender_id AS VARCHAR), 'involved_in', 1 FROM inc
  UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'V' || CAST(l_suppkey AS VARCHAR), 'victim_of', 1 FROM lineitem JOIN inc ON l_orderkey = incident_id),
ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges),
degree AS (SELECT id, count(*) AS degree FROM ends GROUP BY 1)"""

_NODES = """nodes AS (
  SELECT CAST(incident_id AS VARCHAR) AS id, 'incident' AS type, 'Incident ' || CAST(incident_id AS VARCHAR) AS label, crime_type, district,
    strftime(occurrence_datetime, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(occurrence_datetime) % 1000000 = 0 THEN '' ELSE strftime(occurrence_datetime, '.%f') END AS occurrence_datetime,
    CAST(NULL AS VARCHAR) AS police_station FROM inc
  UNION ALL SELECT DISTINCT 'LOC::' || district || '::' || police_station, 'location', police_station || ', ' || district, NULL, district, NULL, police_station FROM inc
  UNION ALL SELECT DISTINCT 'U' || CAST(offender_id AS VARCHAR), 'offender', 'Offender U' || CAST(offender_id AS VARCHAR), NULL, NULL, NULL, NULL FROM inc)"""

_HOPS = """start AS (SELECT 'U' || CAST(offender_id AS VARCHAR) AS id FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
both_ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges),
h1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM start)),
h2 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM h1)),
hops AS (SELECT id, 0 AS hop FROM start UNION ALL SELECT id, 1 FROM h1
  UNION ALL SELECT id, 2 FROM h2 WHERE id NOT IN (SELECT id FROM h1) AND id NOT IN (SELECT id FROM start))"""


def _event_graph(spark, d):
    return graph.build_graph(inputs.event_case_graph(spark, d))


def _start(nodes):
    return nodes.where("type = 'offender'").orderBy(F.col("degree").desc(), "id").limit(1).select("id")


def graph_nodes(spark, d):
    nodes, _ = _event_graph(spark, d)
    return shaped(nodes.drop("latitude", "longitude", "age"))


def graph_edges(spark, d):
    cases, victims = inputs.order_case_graph(spark, d)
    return shaped(graph.graph_edges(cases, victim_links=victims))


def degree_centrality(spark, d):
    cases, victims = inputs.order_case_graph(spark, d)
    nodes, _ = graph.build_graph(cases, victim_links=victims)
    return shaped(nodes.select("id", "degree", "degree_centrality"))


def components(spark, d):
    nodes, edges = _event_graph(spark, d)
    return shaped(graph.components(nodes, edges))


def graph_stats(spark, d):
    nodes, edges = _event_graph(spark, d)
    return shaped(graph.graph_statistics(nodes, edges), 9)


def pruned_graph(spark, d):
    """Edges of people named at least twice in a cell of repeated ids."""
    e = inputs.event_case_graph(spark, d)
    repeated = e.withColumn("offender_id", F.concat_ws(",", F.array_repeat(F.col("offender_id"), (F.col("k") % 7 + 1).cast("int"))))
    _, edges = graph.build_graph(repeated, min_weight=2)
    return shaped(edges)


def k_hop(spark, d):
    nodes, edges = _event_graph(spark, d)
    visited, _ = graph.k_hop(materialize(edges), _start(nodes), 2)
    return shaped(visited)


def k_hop_edges(spark, d):
    nodes, edges = _event_graph(spark, d)
    return shaped(graph.k_hop(materialize(edges), _start(nodes), 2)[1])


def repeat_entities(spark, d):
    cases, victims = inputs.order_case_graph(spark, d)
    nodes, _ = graph.build_graph(cases, victim_links=victims)
    return shaped(graph.repeat_entities(nodes, 12).select("id", "type", "degree"))


def graph_elements(spark, d):
    nodes, edges = _event_graph(spark, d)
    return shaped(graph.graph_elements(nodes, edges))


def node_search(spark, d):
    nodes, _ = _event_graph(spark, d)
    return shaped(graph.search_nodes(nodes, "s1").select("id", "label"))


def visible_subgraph(spark, d):
    nodes, edges = _event_graph(spark, d)
    _, kept = graph.visible_nodes(nodes, edges, ["incident", "location"], drop_edges=True)
    return shaped(kept)


def co_offender_pairs(spark, d):
    bridge = inputs.order_victims(spark, d).withColumnRenamed("victim_id", "offender_id")
    return shaped(linkage.co_offender_pairs(bridge))


def offender_victim_pairs(spark, d):
    return shaped(linkage.offender_victim_pairs(inputs.order_incidents(spark, d), inputs.order_victims(spark, d)))


def person_locations(spark, d):
    e = inputs.event_incidents(spark, d)
    return shaped(linkage.person_locations(e, location_id(F.col("district"), F.col("police_station"))))


def location_visitors(spark, d):
    e = inputs.event_case_graph(spark, d)
    newest = F.to_date(e.agg(F.max("occurrence_datetime")).scalar())
    return shaped(linkage.location_visitors(graph.graph_edges(e), e, newest, 7))


QUERIES = {
    "graph_nodes": (
        graph_nodes,
        with_(EVENTS + ", " + _EDGES + ", " + _NODES, """SELECT n.*, degree, round(degree / ((SELECT count(*) FROM nodes) - 1.0)::DOUBLE, 6) AS degree_centrality
          FROM nodes n JOIN degree USING (id)"""),
    ),
    "graph_edges": (graph_edges, with_(ORDERS + ", " + _ORDER_EDGES, "SELECT source, target, relation, CAST(weight AS BIGINT) AS weight FROM edges")),
    "degree_centrality": (
        degree_centrality,
        with_(ORDERS + ", " + _ORDER_EDGES, "SELECT id, degree, round(degree / ((SELECT count(*) FROM degree) - 1.0)::DOUBLE, 6) AS degree_centrality FROM degree"),
    ),
    "components": (
        components,
        with_(EVENTS + ", " + _EDGES + """, reach AS (SELECT DISTINCT target AS root, target AS id FROM edges WHERE relation = 'occurred_at'
            UNION SELECT r.root, CASE WHEN e.source = r.id THEN e.target ELSE e.source END FROM reach r JOIN edges e ON e.source = r.id OR e.target = r.id),
          home AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)""",
          "SELECT id, min(id) OVER (PARTITION BY root) AS component FROM home", True),
    ),
    "graph_stats": (
        graph_stats,
        with_(EVENTS + ", " + _EDGES + ", " + _NODES, """SELECT n AS node_count, m AS edge_count, (SELECT count(DISTINCT police_station) FROM inc) AS connected_components,
          round(2.0::DOUBLE * m / (n::DOUBLE * (n - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)"""),
    ),
    "pruned_graph": (
        pruned_graph,
        with_(EVENTS, """SELECT CAST(incident_id AS VARCHAR) AS source, 'U' || CAST(offender_id AS VARCHAR) AS target, 'involved_in' AS relation,
          least(k % 7 + 1, 5) AS weight FROM inc WHERE k % 7 + 1 >= 2"""),
    ),
    "k_hop": (k_hop, with_(EVENTS + ", " + _EDGES + ", " + _HOPS, "SELECT id, CAST(hop AS BIGINT) AS hop FROM hops")),
    "k_hop_edges": (
        k_hop_edges,
        with_(EVENTS + ", " + _EDGES + ", " + _HOPS, """SELECT source, target, relation, CAST(weight AS BIGINT) AS weight FROM edges
          WHERE source IN (SELECT id FROM hops WHERE hop < 2) OR target IN (SELECT id FROM hops WHERE hop < 2)"""),
    ),
    "repeat_entities": (
        repeat_entities,
        with_(ORDERS + ", " + _ORDER_EDGES, """SELECT id, CASE WHEN id LIKE 'C%' THEN 'offender' ELSE 'victim' END AS type, degree FROM degree
          WHERE (id LIKE 'C%' OR id LIKE 'V%') AND degree >= 12"""),
    ),
    "graph_elements": (
        graph_elements,
        with_(EVENTS + ", " + _EDGES + ", " + _NODES, """SELECT 'nodes' AS "group", id, label, type, degree, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target,
            CAST(NULL AS BIGINT) AS weight FROM nodes JOIN degree USING (id)
          UNION ALL SELECT 'edges', source || '-' || target, replace(relation, '_', ' '), NULL, NULL, source, target, weight FROM edges"""),
    ),
    "node_search": (
        node_search,
        with_(EVENTS + ", " + _NODES, "SELECT id, label FROM nodes WHERE contains(lower(label), 's1')"),
    ),
    "visible_subgraph": (
        visible_subgraph,
        with_(EVENTS + ", " + _EDGES, "SELECT source, target, relation, CAST(weight AS BIGINT) AS weight FROM edges WHERE relation = 'occurred_at'"),
    ),
    "co_offender_pairs": (
        co_offender_pairs,
        """WITH b AS (SELECT DISTINCT l_orderkey AS i, l_suppkey AS p FROM lineitem)
        SELECT a.p AS person_a, b.p AS person_b, count(*) AS incidents FROM b a JOIN b ON a.i = b.i AND a.p < b.p GROUP BY 1, 2""",
    ),
    "offender_victim_pairs": (
        offender_victim_pairs,
        """WITH b AS (SELECT DISTINCT l_orderkey AS i, l_suppkey AS p FROM lineitem)
        SELECT CAST(o_custkey AS VARCHAR) AS offender_id, CAST(p AS VARCHAR) AS victim_id, count(*) AS incidents FROM orders JOIN b ON o_orderkey = i GROUP BY 1, 2""",
    ),
    "person_locations": (
        person_locations,
        with_(EVENTS, """SELECT offender_id AS person_id, 'LOC::' || district || '::' || police_station AS location_id, count(*) AS visits,
          array_to_string(list_sort(list(DISTINCT crime_type)), ',') AS crime_types, max(occurrence_datetime) AS last_seen FROM inc GROUP BY 1, 2"""),
    ),
    "location_visitors": (
        location_visitors,
        with_(EVENTS, """SELECT 'LOC::' || district || '::' || police_station AS location_id, 'U' || CAST(offender_id AS VARCHAR) AS person_id, 'involved_in' AS relation,
          count(*) AS visits, max(occurrence_datetime) AS last_seen FROM inc
          WHERE CAST((SELECT max(occurrence_datetime) FROM inc) AS DATE) - CAST(occurrence_datetime AS DATE) BETWEEN 0 AND 7 GROUP BY 1, 2"""),
    ),
}
