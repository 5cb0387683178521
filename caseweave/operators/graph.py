"""Incident / location / person graph as two tables, with degrees, pruning and neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import id_array, id_list, location_id
from ..functions.timeparts import iso_text
from .checks import require_columns
from .cleaning import TREND_COLUMNS
from .components import connected_components
from .scale import materialize, scalar_of, skew_safe_join

NODE_COLUMNS = [
    "id", "type", "label", "degree", "degree_centrality", "crime_type", "district",
    "occurrence_datetime", "police_station", "latitude", "longitude", "age",
]
ATTRIBUTES = ["label", "crime_type", "district", "occurrence_datetime", "police_station", "latitude", "longitude"]


def _people(df: DataFrame, column: str) -> Column:
    is_array = isinstance(df.schema[column].dataType, T.ArrayType)
    return id_array(F.col(column)) if is_array else id_list(F.col(column))


def _optional(df: DataFrame, column: str, kind: str) -> Column:
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)


def _time_text(df: DataFrame) -> Column:
    c = F.col("occurrence_datetime")
    timed = df.schema["occurrence_datetime"].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    return iso_text(c) if timed else c.cast("string")


def _prepared(df: DataFrame) -> DataFrame:
    """One row per incident row: ids as text, the location node, and the people arrays."""
    require_columns(df, TREND_COLUMNS, "incidents")
    none = F.array().cast("array<string>")
    with_station = "police_station" in df.columns
    place = location_id(F.col("district"), F.col("police_station") if with_station else None)
    label = F.concat_ws(", ", F.col("police_station").cast("string"), F.col("district").cast("string")) if with_station else F.col("district").cast("string")
    return df.select(
        F.col("incident_id").alias("_pos"),
        F.col("incident_id").cast("string").alias("incident"),
        F.col("crime_type").cast("string").alias("crime_type"),
        F.col("district").cast("string").alias("district"),
        _time_text(df).alias("occurrence_datetime"),
        _optional(df, "police_station", "string").alias("police_station"),
        _optional(df, "latitude", "double").alias("latitude"),
        _optional(df, "longitude", "double").alias("longitude"),
        place.alias("location"),
        label.alias("location_label"),
        (_people(df, "offender_id") if "offender_id" in df.columns else none).alias("offenders"),
        (_people(df, "victim_id") if "victim_id" in df.columns else none).alias("victims"),
    )


def _linked(incidents: DataFrame, links: DataFrame) -> DataFrame:
    """Bridge rows (incident_id, person) of known incidents: position, incident, person, repeats."""
    person = next(c for c in links.columns if c != "incident_id")
    rows = links.where(F.col(person).isNotNull()).groupBy("incident_id", person).agg(F.count(F.lit(1)).alias("n"))
    known = skew_safe_join(rows, incidents.select("incident_id").distinct(), ["incident_id"], "left_semi")
    return known.select(
        F.col("incident_id").alias("_pos"), F.col("incident_id").cast("string").alias("source"),
        F.col(person).cast("string").alias("target"), F.col("n"),
    )


def graph_edges(
    incidents: DataFrame, weight_cap: int = 5, offender_links: DataFrame | None = None, victim_links: DataFrame | None = None
) -> DataFrame:
    """(source, target, relation, weight); the source is the incident. One edge per unordered pair,
    the first writer in id order wins. Weight counts repeats inside one incident, up to
    ``weight_cap``. People come from the incident's own columns, from bridge tables, or both; a
    bridge needs no array per incident, however many people it names."""
    p = _prepared(incidents)

    def bridged(links: DataFrame, rank: int) -> DataFrame:
        weight = F.least(F.col("n"), F.lit(weight_cap)).cast("bigint")
        return _linked(incidents, links).select(
            "_pos", "source", "target", weight.alias("weight"), F.lit(rank).alias("_rank")
        )

    def people(column: str, rank: int) -> DataFrame:
        ids = F.array_distinct(F.col(column))
        repeats = F.transform(
            ids, lambda i: F.struct(i.alias("target"), F.size(F.filter(F.col(column), lambda x: x == i)).alias("n"))
        )
        return p.select("_pos", F.col("incident").alias("source"), F.explode(repeats).alias("t")).select(
            "_pos", "source", F.col("t.target").alias("target"),
            F.least(F.col("t.n"), F.lit(weight_cap)).cast("bigint").alias("weight"), F.lit(rank).alias("_rank"),
        )

    places = p.select(
        "_pos", F.col("incident").alias("source"), F.col("location").alias("target"),
        F.lit(1).cast("bigint").alias("weight"), F.lit(1).alias("_rank"),
    )
    every = places.unionByName(people("offenders", 2)).unionByName(people("victims", 3))
    if offender_links is not None:
        every = every.unionByName(bridged(offender_links, 2))
    if victim_links is not None:
        every = every.unionByName(bridged(victim_links, 3))
    # One end of a pair is the source, and the rank names the relation: neither travels twice.
    ends = every.select(
        "_pos", "_rank", "weight", F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b"), (F.col("source") <= F.col("target")).alias("forward")
    )
    first = F.min_by(F.struct("weight", "_rank", "forward"), F.struct("_pos", "_rank"))
    kept = ends.groupBy("_a", "_b").agg(first.alias("e"))
    source = F.when(F.col("e.forward"), F.col("_a")).when(~F.col("e.forward"), F.col("_b"))  # null for an incident without an id
    target = F.when(F.col("e.forward"), F.col("_b")).otherwise(F.col("_a"))
    relation = F.when(F.col("e._rank") == 1, "occurred_at").when(F.col("e._rank") == 2, "involved_in").otherwise("victim_of")
    return kept.select(source.alias("source"), target.alias("target"), relation.alias("relation"), F.col("e.weight").alias("weight"))


def _raw_nodes(incidents: DataFrame, links: dict[str, DataFrame | None]) -> DataFrame:
    p = _prepared(incidents)
    blank = {"crime_type": "string", "district": "string", "occurrence_datetime": "string",
             "police_station": "string", "latitude": "double", "longitude": "double"}

    def empty(*names: str) -> list[Column]:
        return [F.lit(None).cast(t).alias(n) for n, t in blank.items() if n in names]

    def shaped(df: DataFrame, kind: str, rank: int) -> DataFrame:
        return df.select("_pos", F.lit(rank).alias("_rank"), "id", F.lit(kind).alias("type"), F.struct(*ATTRIBUTES).alias("at"))

    cases = p.select(
        "_pos", F.col("incident").alias("id"), F.concat(F.lit("Incident "), F.col("incident")).alias("label"),
        "crime_type", "district", "occurrence_datetime", "latitude", "longitude", *empty("police_station"),
    )
    spots = p.select(
        "_pos", F.col("location").alias("id"), F.col("location_label").alias("label"), "district", "police_station",
        *empty("crime_type", "occurrence_datetime", "latitude", "longitude"),
    )
    # A busy place or person appears in many rows; each task reduces them to their first position.
    spots = spots.groupBy(*[c for c in spots.columns if c != "_pos"]).agg(F.min("_pos").alias("_pos"))
    out = shaped(cases, "incident", 0).unionByName(shaped(spots, "location", 1))
    for column, kind, rank in (("offenders", "offender", 2), ("victims", "victim", 3)):
        named = p.select("_pos", F.explode(F.array_distinct(column)).alias("id"))
        if links.get(kind) is not None:
            named = named.unionByName(_linked(incidents, links[kind]).select("_pos", F.col("target").alias("id")))
        people = named.groupBy("id").agg(F.min("_pos").alias("_pos")).select(
            "_pos", "id", F.concat(F.lit(kind.capitalize() + " "), F.col("id")).alias("label"), *empty(*blank)
        )
        out = out.unionByName(shaped(people, kind, rank))
    return out


def graph_nodes(
    incidents: DataFrame,
    offender_ages: DataFrame | None = None,
    victim_ages: DataFrame | None = None,
    offender_links: DataFrame | None = None,
    victim_links: DataFrame | None = None,
) -> DataFrame:
    """Nodes without degrees. All types share one id space: an incident row always defines its node
    (the last one wins); otherwise the first writer in id order does. Age tables hold (id, age)."""
    is_case = F.col("type") == "incident"
    links = {"offender": offender_links, "victim": victim_links}
    merged = _raw_nodes(incidents, links).groupBy("id").agg(
        F.min_by(F.struct("type", "at"), F.struct("_pos", "_rank")).alias("f"),
        F.max_by(F.when(is_case, F.struct("type", "at")), F.when(is_case, F.struct(F.col("_pos"), F.col("at.occurrence_datetime")))).alias("c"),
    ).select("id", F.coalesce("c", "f").alias("n"), F.col("f.type").alias("_first"))
    nodes = merged.select("id", "_first", F.col("n.type").alias("type"), "n.at.*")
    for ages, kind in ((offender_ages, "offender"), (victim_ages, "victim")):
        if ages is not None:
            known = ages.select(
                F.col(ages.columns[0]).cast("string").alias("id"), F.lit(kind).alias("_first"),
                F.col(ages.columns[1]).cast("int").alias(f"_{kind}_age"),
            )
            nodes = nodes.join(known, ["id", "_first"], "left")
    found = [F.col(c) for c in ("_offender_age", "_victim_age") if c in nodes.columns]
    age = F.coalesce(*found) if found else F.lit(None).cast("int")
    return nodes.withColumn("age", age).drop("_first", "_offender_age", "_victim_age")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree). Each task adds up its own part of a hub before the shuffle."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    others = scalar_of(nodes, F.count(F.lit(1))) - 1
    degree = F.coalesce("degree", F.lit(0)).cast("bigint")
    return (
        nodes.join(degrees(edges), "id", "left")
        .withColumns(
            {"degree": degree, "degree_centrality": F.round(F.coalesce(F.try_divide(degree.cast("double"), others.cast("double")), F.lit(0.0)), 6)}
        )
        .select(*NODE_COLUMNS)
    )


def prune(nodes: DataFrame, edges: DataFrame, min_weight: int) -> tuple[DataFrame, DataFrame]:
    """Drop lighter edges, then nodes without any edge; does nothing for ``min_weight`` <= 1."""
    if min_weight <= 1:
        return nodes, edges
    kept = edges.where(F.col("weight") >= min_weight)
    touched = kept.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_semi"), kept


def build_graph(
    incidents: DataFrame,
    offender_ages: DataFrame | None = None,
    victim_ages: DataFrame | None = None,
    weight_cap: int = 5,
    min_weight: int = 1,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    offender_links: DataFrame | None = None,
    victim_links: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes with degrees, edges). ``keep`` may be ``scale.materialize`` to compute each side once."""
    nodes, edges = prune(
        keep(graph_nodes(incidents, offender_ages, victim_ages, offender_links, victim_links)),
        keep(graph_edges(incidents, weight_cap, offender_links, victim_links)),
        min_weight,
    )
    return with_degrees(nodes, edges), edges


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(edges, nodes, "source", "target", "id")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, connected_components, density. Writes intermediate tables."""
    nodes, edges = materialize(nodes.select("id")), materialize(edges.select("source", "target"))
    parts = scalar_of(components(nodes, edges), F.count_distinct("component"))
    m = scalar_of(edges, F.count(F.lit(1)))
    n = F.col("node_count").cast("double")
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).select(
        "node_count",
        m.alias("edge_count"),
        parts.alias("connected_components"),
        F.coalesce(F.try_divide(2.0 * m, n * (n - 1.0)), F.lit(0.0)).alias("density"),
    )


def repeat_entities(nodes: DataFrame, min_degree: int = 2, types: Sequence[str] = ("offender", "victim")) -> DataFrame:
    return nodes.where(F.col("type").isin(*types) & (F.col("degree") >= min_degree)).orderBy(
        F.col("degree").desc(), "id"
    )


def edges_of(edges: DataFrame, frontier: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges touching a node of ``frontier`` (column id) at either end. Semi-joins leave the large
    edge table in place whenever the frontier is small."""
    pool = edges if relation is None else edges.where(F.col("relation") == relation)
    out = pool.join(frontier.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns)
    into = pool.join(frontier.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    return out.unionByName(into).distinct()


def k_hop(edges: DataFrame, start: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with their hop, distinct edges) reachable from ``start`` (column id) in ``hops`` steps.

    The edges of the last frontier are not followed; without a hop there are none. Writes one small table per hop.
    """
    visited = start.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = visited.select("id")
    collected = edges.limit(0)
    for hop in range(1, hops + 1):
        touched = materialize(edges_of(edges, frontier))
        collected = collected.unionByName(touched)
        ends = touched.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        fresh = materialize(ends.join(visited, "id", "left_anti"))
        visited = visited.unionByName(fresh.withColumn("hop", F.lit(hop)))
        frontier = fresh
        if fresh.isEmpty():
            break
    return visited, collected.distinct()


def resolve_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Node rows for the wanted ids; ids without a node are dropped."""
    return nodes.join(ids.select("id"), "id", "left_semi")


def incident_subgraph(nodes: DataFrame, edges: DataFrame, incident: str) -> tuple[DataFrame, DataFrame]:
    """Edges written by one incident and the nodes they touch."""
    own = edges.where(F.col("source") == incident)
    ends = own.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return resolve_nodes(nodes, ends), own


def visible_nodes(nodes: DataFrame, edges: DataFrame, types: Sequence[str], drop_edges: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of the shown types. Edges stay unless ``drop_edges`` asks for both ends to be shown."""
    kept = nodes.where(F.col("type").isin(*types))
    if not drop_edges:
        return kept, edges
    ids = kept.select("id")
    both = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return kept, both.select(*edges.columns)


def search_nodes(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("label"), F.lit(text.lower())))


def graph_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as one element list; edge labels are the relation in words."""
    n = nodes.select(F.lit("nodes").alias("group"), "id", "label", "type", "degree")
    e = edges.select(
        F.lit("edges").alias("group"), F.concat_ws("-", "source", "target").alias("id"), "source", "target",
        F.translate("relation", "_", " ").alias("label"), "weight",
    )
    return n.unionByName(e, allowMissingColumns=True)
