"""Registered queries: tables that grow by batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import graph
from ...operators.scale import materialize, shared_folder
from ...sources import store
from ...sources.keyed import KeyedTable
from ...streaming import enrich, groups, intake, tables, text_index, windows
from .. import inputs
from . import networks, stores
from .common import GEO, shaped, with_
from .texts import _PART_DOCS


_BUCKETS = 8


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/caseweave/{uuid.uuid4().hex}"


def _in_turn(spark, slices, folder, run):
    """Write slice after slice and let the stream take each before the next comes. Every run goes on from the checkpoint."""
    for i, rows in enumerate(slices):
        rows.write.parquet(f"{folder}/source/{i}")
        run(i, spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{folder}/source"))


def _cut(rows, number, n):
    return [rows.where(number == i) for i in range(n)]


def _in_batches(table, rows, number, n):
    """Add the rows in ``n`` batches, the last but one twice, and compact on the way."""
    for i in range(n):
        table.append(rows.where(number == i), i)
        if i == n - 2:
            table.append(rows.where(number == i), i)
            table.compact(i - 1)
    return table


def compacted_nodes(spark, d):
    e = inputs.event_incidents(spark, d)
    rows = store.node_rows(e, F.lit("offender"), F.col("offender_id"), F.concat(F.lit("case "), F.col("incident_id").cast("string")), F.col("occurrence_datetime"))
    table = KeyedTable(spark, _folder(spark), rows.schema, store.NODE_KEYS, store.node_merge, buckets=_BUCKETS)
    number = F.regexp_extract("display_name", r"(\d+)$", 1).cast("bigint") % 4
    _in_batches(table, rows, number, 4).compact()
    return shaped(table.read())


def compacted_edges(spark, d):
    """Every line of an order writes the order's edge to its supplier again; the last batch is not compacted."""
    l = inputs.table(spark, d, "lineitem")
    rows = store.edge_rows(
        l, F.col("l_orderkey"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.lit("victim_of"), F.col("l_shipdate")
    )
    table = KeyedTable(spark, _folder(spark), rows.schema, store.EDGE_KEYS, store.edge_merge, buckets=_BUCKETS)
    return shaped(_in_batches(table, rows, F.dayofyear("created_at") % 4, 4).read())


def windowed_daily_counts(spark, d):
    """Events in three slices, of which the second is the newest and the third brings days that closed."""
    folder = _folder(spark)
    e = inputs.event_incidents(spark, d)
    day = F.dayofmonth("occurrence_datetime")
    number = F.when(day <= 10, 0).when(day > 20, 1).otherwise(2)
    run = lambda _, stream: windows.run_windowed_counts(stream, f"{folder}/tables", f"{folder}/checkpoint")
    _in_turn(spark, _cut(e, number, 3), folder, run)
    return shaped(windows.windowed_counts(spark, f"{folder}/tables"))


def streamed_components(spark, d):
    folder = _folder(spark)
    edges = materialize(graph.graph_edges(inputs.event_case_graph(spark, d)).select("source", "target"))
    run = lambda _, stream: groups.run_components(stream, f"{folder}/tables", f"{folder}/checkpoint", buckets=_BUCKETS)
    _in_turn(spark, _cut(edges, F.pmod(F.xxhash64("source"), F.lit(4)), 4), folder, run)
    return shaped(groups.Groups(spark, f"{folder}/tables", buckets=_BUCKETS).current().withColumnRenamed("node", "id"))


def streamed_text_matches(spark, d):
    """Matches of every part among the parts of its slice and of the slices before; words weigh as in the first slice."""
    folder = _folder(spark)
    parts = inputs.part_cases(spark, d)
    number = F.col("incident_id") % 3

    def run(i, stream):
        text_index.run_text_matches(stream, parts.where(number == 0) if i == 0 else None, f"{folder}/tables", f"{folder}/checkpoint", buckets=_BUCKETS)

    _in_turn(spark, _cut(parts, number, 3), folder, run)
    return shaped(text_index.text_matches(spark, f"{folder}/tables"))


def streamed_tag_matches(spark, d):
    """Tag links of every part with its five best matches among the parts of its slice and of the slices before."""
    folder = _folder(spark)
    p = inputs.part_cases(spark, d)
    cases = p.select(
        "incident_id", F.col("crime_type").alias("district"), "crime_type", F.lit("2024-01-01").cast("timestamp_ntz").alias("occurrence_datetime"), F.col("crime_type").alias("police_station"),
        F.col("incident_id").alias("offender_id"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), "mo_tags",
    )
    run = lambda _, stream: enrich.run_enrichment(stream, f"{folder}/tables", f"{folder}/checkpoint", top_k=5)
    _in_turn(spark, _cut(cases, F.col("incident_id") % 3, 3), folder, run)
    links = tables.read_all(spark, f"{folder}/tables", "mo_edges")
    return shaped(links.select("source", "target", "shared_mo_tags", "similarity_score", "auto_linked", "verified_by_investigator"))


def streamed_intake(spark, d):
    """Payloads in two slices; every tenth is delivered three times, in both slices, and every tenth comes again with another author. Accepted
    numbers, and rejected rows with their faults."""
    folder = _folder(spark)
    p, i = inputs.intake_payloads(spark, d).withColumn("narrative_text", F.lit(None).cast("string")), F.col("event_id")
    again, other = p.where(i % 10 == 0), p.where(i % 10 == 6).withColumn("created_by", F.lit("other"))
    known = spark.createDataFrame([], "offender_id string")
    run = lambda _, stream: intake.run_intake(stream, known, f"{folder}/tables", f"{folder}/checkpoint")
    _in_turn(spark, [p.where(i % 2 == 0).unionByName(again), p.where(i % 2 == 1).unionByName(again).unionByName(other)], folder, run)
    stored = tables.read_all(spark, f"{folder}/tables", "incidents").select("fir_number", F.lit(None).cast("bigint").alias("event_id"), "created_by", F.lit("").alias("faults"))
    fault = lambda e: F.concat(e["field"], F.when(e["message"] == "already recorded", " again").otherwise(""))
    rejected = tables.read_all(spark, f"{folder}/tables", "rejected").select("fir_number", "event_id", "created_by", F.array_join(F.transform("field_errors", fault), ",").alias("faults"))
    return shaped(stored.unionByName(rejected))


def reraised_flags(spark, d):
    """Hotspot flags of three slices, where every flag is dismissed before the next slice comes."""
    folder = _folder(spark)

    def dismissed():
        flags = tables.read_all(spark, f"{folder}/tables", "flags")
        return flags.select("flag_id", F.lit("DISMISS").alias("decision"), F.lit("no").alias("reason"), "created_at", F.col("flag_id").alias("decision_id"))

    run = lambda _, stream: enrich.run_enrichment(stream, f"{folder}/tables", f"{folder}/checkpoint", decisions=dismissed)
    _in_turn(spark, _cut(inputs.geo_incidents(spark, d), F.col("incident_id") % 3, 3), folder, run)
    flags = tables.read_all(spark, f"{folder}/tables", "flags").where("flag_type = 'HOTSPOT'")
    return shaped(flags.select("flag_id", "severity", "confidence_score", "target_id", "jurisdiction_id", "status"))


_FROZEN = """, tok AS (SELECT block, doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM docs),
tf AS (SELECT block, doc, token, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
df AS (SELECT block, token, count(*) AS df FROM tf WHERE CAST(doc AS BIGINT) % 3 = 0 GROUP BY 1, 2),
n AS (SELECT block, count(*) AS n FROM docs WHERE CAST(doc AS BIGINT) % 3 = 0 GROUP BY 1),
raw AS (SELECT t.block, t.doc, t.token, t.tf * (ln((1.0 + coalesce(n.n, 0)) / (1.0 + coalesce(d.df, 0))) + 1.0) AS w FROM tf t LEFT JOIN df d USING (block, token) LEFT JOIN n USING (block)),
unit AS (SELECT block, doc, token, w / sqrt(sum(w * w) OVER (PARTITION BY block, doc)) AS w FROM raw),
score AS (SELECT a.doc AS a, b.doc AS b, round(least(1.0, sum(a.w * b.w)), 9) AS s FROM unit a JOIN unit b ON a.block = b.block AND a.token = b.token AND a.doc <> b.doc
  WHERE CAST(b.doc AS BIGINT) % 3 <= CAST(a.doc AS BIGINT) % 3 GROUP BY 1, 2)"""

QUERIES = {
    "compacted_nodes": (compacted_nodes, stores.QUERIES["upsert_nodes"][1]),
    "compacted_edges": (compacted_edges, stores.QUERIES["upsert_edges"][1]),
    "windowed_daily_counts": (windowed_daily_counts, stores.QUERIES["streamed_daily_counts"][1]),
    "streamed_components": (streamed_components, networks.QUERIES["components"][1]),
    "streamed_text_matches": (
        streamed_text_matches,
        with_(_PART_DOCS + _FROZEN, """SELECT a AS incident_id, b AS matched_incident_id, round(s, 6) AS similarity_score FROM (
          SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM score WHERE s >= 0.3) WHERE r <= 5"""),
    ),
    "streamed_tag_matches": (
        streamed_tag_matches,
        with_("p AS (SELECT p_partkey AS k, list_sort(list_distinct(string_split(p_name, ' '))) AS t FROM part)", """SELECT source, target, array_to_string(shared, ',') AS shared_mo_tags,
          j AS similarity_score, true AS auto_linked, false AS verified_by_investigator FROM (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY j DESC, target) AS r FROM (
              SELECT a.k AS source, b.k AS target, list_sort(list_intersect(a.t, b.t)) AS shared,
                round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 4) AS j
              FROM p a JOIN p b ON a.k <> b.k AND b.k % 3 <= a.k % 3 AND list_has_any(a.t, b.t)) WHERE j >= 0.4) WHERE r <= 5 AND j >= 0.5"""),
    ),
    "streamed_intake": (
        streamed_intake,
        """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        p AS (SELECT event_id, CASE WHEN k < 5 THEN ' ' ELSE 'F-' || event_id END AS fir_number, CASE WHEN event_id % 11 <> 0 THEN 'officer' END AS created_by, list_filter([
            CASE WHEN k < 5 THEN 'fir_number' END, CASE WHEN event_type = 'signup' THEN 'incident_type' END,
            CASE WHEN event_id % 7 = 0 THEN 'reported_at' END, CASE WHEN event_id % 11 = 0 THEN 'created_by' END,
            CASE WHEN event_id % 13 = 0 THEN 'location' END,
            CASE WHEN event_id % 13 <> 0 AND (k > 90 OR k * 2 > 180) THEN 'location.latitude/longitude' END,
            CASE WHEN event_id % 13 <> 0 AND event_id % 5 = 0 THEN 'location.district_id' END], lambda x: x IS NOT NULL) AS l FROM e),
        o AS (SELECT event_id, fir_number, 'other' AS created_by, list_concat(list_filter(l, lambda x: x <> 'created_by'), CASE WHEN len(l) = 0 THEN ['fir_number again'] ELSE [] END) AS l FROM p WHERE event_id % 10 = 6),
        a AS (SELECT event_id, fir_number, created_by, l FROM p UNION ALL SELECT * FROM o)
        SELECT fir_number, CASE WHEN len(l) > 0 THEN event_id END AS event_id, created_by, coalesce(array_to_string(l, ','), '') AS faults FROM a""",
    ),
    "reraised_flags": (
        reraised_flags,
        with_(GEO + """, c AS (SELECT police_station, CAST(round(latitude * 100) AS BIGINT) AS y, CAST(round(longitude * 100) AS BIGINT) AS x, incident_id % 3 AS b, count(*) AS n FROM geo GROUP BY 1, 2, 3, 4),
          s AS (SELECT *, sum(n) OVER (PARTITION BY police_station, y, x ORDER BY b) AS m FROM c),
          f AS (SELECT printf('HS_%s_%.2f_%.2f', police_station, y / 100.0, x / 100.0) AS id, police_station, b, round(least(1.0, 0.4 + m * 0.1), 2)::DOUBLE AS score FROM s WHERE m >= 3)""",
          """SELECT 'FLAG_HS_' || id || '@' || b AS flag_id, CASE WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
            score AS confidence_score, id AS target_id, police_station AS jurisdiction_id, 'PENDING' AS status FROM f"""),
    ),
}
