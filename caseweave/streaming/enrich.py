"""Enrichment of new incidents: entity links, similar-method matches, hotspot and trend flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import location_id
from ..operators import flags as flag_ops
from ..operators.hotspots import CELL, count_merge, grid_counts, hotspots_of_counts
from ..operators.review import current_flags
from ..operators.scale import materialize
from ..operators.similarity import match_edges
from ..operators.trend import spikes_of_days, type_days
from ..sources.keyed import KeyedTable, compact_every
from ..sources.store import EDGE_KEYS, NODE_KEYS, edge_merge, edge_rows, node_merge
from .tables import prepare, read_all, read_before, run_available, write_batch
from .text_index import TagIndex

#: Batches after which the keyed tables are compacted.
COMPACT_EVERY = 8

FLAG_SCHEMA = (
    "flag_id string, flag_type string, severity string, title string, summary string, confidence_score double, "
    "target_type string, target_id string, jurisdiction_id string, evidence_payload string, status string, created_at timestamp"
)
NODE_SCHEMA = "node_id string, node_type string, ref_id string, display_name string, created_at timestamp, updated_at timestamp"
EDGE_SCHEMA = (
    "edge_id string, from_node_id string, to_node_id string, relation_type string, incident_id string, weight double, created_at timestamp"
)


def entity_edges(incidents: DataFrame, now: Column) -> DataFrame:
    """Suspect-to-location and suspect-to-victim links of the given incidents."""
    place = location_id(F.col("district"), F.col("police_station"))
    who = F.concat(F.lit("offender_"), F.col("offender_id").cast("string"))
    named = incidents.where(F.col("offender_id").isNotNull())
    out = edge_rows(named, F.col("incident_id"), who, place, F.lit("occurred_at"), now)
    if "victim_id" in incidents.columns:
        both = named.where(F.col("victim_id").isNotNull())
        victim = F.concat(F.lit("victim_"), F.col("victim_id").cast("string"))
        out = out.unionByName(edge_rows(both, F.col("incident_id"), who, victim, F.lit("TARGETED"), now))
    return out


def entity_nodes(incidents: DataFrame, now: Column) -> DataFrame:
    """The suspects, victims and locations of the given incidents, with the ids that their links use; each once."""
    place = location_id(F.col("district"), F.col("police_station"))

    def rows(kind: str, node: Column, ref: Column) -> DataFrame:
        found = incidents.select(node.alias("node_id"), F.lit(kind).alias("node_type"), ref.cast("string").alias("ref_id")).where("ref_id is not null")
        return found.distinct().select("*", F.col("ref_id").alias("display_name"), now.alias("created_at"), now.alias("updated_at"))

    person = lambda kind: rows(kind, F.concat(F.lit(f"{kind}_"), F.col(f"{kind}_id").cast("string")), F.col(f"{kind}_id"))
    out = person("offender").unionByName(rows("location", place, place))
    return out.unionByName(person("victim")) if "victim_id" in incidents.columns else out


def batch_flags(
    cells: DataFrame, fresh_days: DataFrame, all_days: DataFrame, pending: DataFrame, as_of: Column, now: Column, matches: DataFrame | None = None,
) -> DataFrame:
    """New flags caused by a batch: only its cells (``cells`` has their running counts) and types are looked at again. Candidates with an equal
    pending flag are dropped."""
    spots = hotspots_of_counts(cells)
    spikes = spikes_of_days(all_days.join(fresh_days.select("crime_type").distinct(), "crime_type", "left_semi"), as_of)
    out = flag_ops.without_pending_target(flag_ops.hotspot_flags(spots, now), pending).unionByName(
        flag_ops.without_pending_type(flag_ops.trend_flags(spikes, now), pending)
    )
    if matches is not None:
        found = flag_ops.without_pending_target(flag_ops.match_flags(matches, now), pending)
        out = out.unionByName(found)
    return out


def raised_in(flags: DataFrame, batch: int) -> DataFrame:
    """Flags with an id of this raising, so that a flag raised again does not inherit the decision on the earlier one."""
    return flags.withColumn("flag_id", F.concat("flag_id", F.lit(f"@{batch}")))


def run_enrichment(
    incidents: DataFrame, folder: str, checkpoint: str, as_of: Column | None = None, decisions: Callable[[], DataFrame] | None = None,
    top_k: int | None = None,
) -> None:
    """Per batch: store the incidents, their entities and links, tag matches (edges from 0.5, flags from
    0.7) and the flags they cause. ``decisions`` gives the review decisions so far; a target whose flag was decided may be flagged again.
    ``top_k`` keeps the best tag matches of each incident only.

    Entities, links, and the cell and day counts from which flags follow are keyed tables: a batch adds its own rows, reads the buckets of
    its own cells, and now and then the batches before it are merged. Tags are matched by a stored index; no incident is read again.
    """
    spark = incidents.sparkSession
    has_tags = "mo_tags" in incidents.columns
    prepare(spark, folder, {"flags": FLAG_SCHEMA})
    nodes, edges = node_table(spark, folder), edge_table(spark, folder)
    cells = KeyedTable(spark, f"{folder}/cell_counts", grid_counts(incidents).schema, [*CELL, "district", "crime_type"], count_merge, CELL)
    days = KeyedTable(spark, f"{folder}/type_days", type_days(incidents).schema, ["crime_type", "date"], lambda: [F.sum("n").alias("n")])

    tag_index = TagIndex(spark, f"{folder}/tag_index", incidents.schema["incident_id"].dataType.simpleString(), top_k=top_k) if has_tags else None

    def apply(df: DataFrame, batch: int) -> None:
        compact_every([nodes, edges, cells, days, *([tag_index.postings, tag_index.members] if has_tags else [])], batch, COMPACT_EVERY)
        write_batch(df, folder, "incidents", batch)
        fresh = read_all(spark, folder, "incidents").where(F.col("batch") == batch).drop("batch")
        stamp = F.current_timestamp()
        nodes.append(entity_nodes(fresh, stamp), batch)
        edges.append(entity_edges(fresh, stamp), batch)
        cells.append(grid_counts(fresh), batch)
        days.append(type_days(fresh), batch)
        matches = None
        if has_tags:
            matches = materialize(tag_index.add(fresh, batch))
            write_batch(match_edges(matches), folder, "mo_edges", batch)
        all_days = days.read(batch)
        newest = all_days.agg(F.max("date")).scalar() if as_of is None else as_of
        earlier = read_before(spark, folder, "flags", batch)
        pending = earlier if decisions is None else current_flags(earlier, decisions())
        found = batch_flags(cells.lookup(grid_counts(fresh), batch), type_days(fresh), all_days, pending, newest, stamp, matches)
        write_batch(raised_in(found, batch), folder, "flags", batch)

    run_available(incidents.writeStream.foreachBatch(apply), checkpoint)


def node_table(spark, folder: str) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/entity_nodes", NODE_SCHEMA, NODE_KEYS, node_merge)


def edge_table(spark, folder: str) -> KeyedTable:
    """A replayed incident does not add weight."""
    return KeyedTable(spark, f"{folder}/entity_edges", EDGE_SCHEMA, EDGE_KEYS, lambda: edge_merge(add_weight=False))


def current_nodes(spark, folder: str) -> DataFrame:
    """Entities by id, with the first and the last time they were met."""
    return node_table(spark, folder).read()


def current_edges(spark, folder: str) -> DataFrame:
    """Entity links by id."""
    return edge_table(spark, folder).read()
