"""Person and place links derived from the incident bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import skew_safe_join

# People of an incident are compared in blocks of about this many, so that no array or task grows with the incident.
BLOCK_PEOPLE = 64


def _block(person: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(person), blocks.cast("bigint"))


def _blocks_of(people: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(people / BLOCK_PEOPLE)).cast("bigint")


def co_offender_pairs(bridge: DataFrame, person: str = "offender_id") -> DataFrame:
    """(person_a, person_b, incidents) with a < b, for every pair of every incident.

    The people of an incident are dealt into blocks by hash; block i meets block j >= i in a group of its own. Pairs are formed inside
    the short arrays of a group.
    """
    rows = bridge.where(F.col(person).isNotNull()).select("incident_id", F.col(person).alias("p")).distinct()
    sizes = rows.groupBy("incident_id").agg(_blocks_of(F.count(F.lit(1))).alias("blocks"))
    placed = skew_safe_join(rows, sizes, ["incident_id"]).withColumn("own", _block(F.col("p"), F.col("blocks")))
    dealt = placed.select("incident_id", "p", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = lambda block: F.collect_list(F.when(F.col("own") == F.col(block), F.col("p")))
    met = dealt.select("incident_id", "p", "own", low.alias("low"), high.alias("high")).groupBy("incident_id", "low", "high").agg(side("low").alias("ls"), side("high").alias("hs"))
    apart = F.col("low") != F.col("high")
    pairs = met.select(apart.alias("apart"), "hs", F.explode("ls").alias("a")).select("apart", "a", F.explode("hs").alias("b")).where("apart or a < b")
    return pairs.groupBy(F.least("a", "b").alias("person_a"), F.greatest("a", "b").alias("person_b")).agg(F.count(F.lit(1)).alias("incidents"))


def offender_victim_pairs(offenders: DataFrame, victims: DataFrame) -> DataFrame:
    """(offender_id, victim_id, incidents) for everyone on the two sides of an incident; blocks as above, on each side."""
    sides = [
        df.where(F.col(name).isNotNull()).select("incident_id", F.col(name).cast("string").alias("p")).distinct()
        for df, name in ((offenders, "offender_id"), (victims, "victim_id"))
    ]
    sizes = [df.groupBy("incident_id").agg(_blocks_of(F.count(F.lit(1))).alias(name)) for df, name in zip(sides, ("o", "v"))]
    blocks = sizes[0].join(sizes[1], "incident_id")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        placed = skew_safe_join(df, blocks, ["incident_id"])
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{other}_block")
        return placed.select("incident_id", F.lit(own).alias("side"), "p", _block(F.col("p"), F.col(own)).alias(f"{own}_block"), every)

    both = dealt(sides[0], "o", "v").unionByName(dealt(sides[1], "v", "o"))
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.col("p")))
    met = both.groupBy("incident_id", "o_block", "v_block").agg(side("o").alias("os"), side("v").alias("vs"))
    pairs = met.select(F.explode("os").alias("offender_id"), "vs").select("offender_id", F.explode("vs").alias("victim_id"))
    return pairs.groupBy("offender_id", "victim_id").agg(F.count(F.lit(1)).alias("incidents"))


def person_locations(incidents: DataFrame, place: Column, person: str = "offender_id") -> DataFrame:
    """Suspect-to-location links: visits, crime types and the last visit."""
    return (
        incidents.where(F.col(person).isNotNull())
        .groupBy(F.col(person).alias("person_id"), place.alias("location_id"))
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.array_sort(F.collect_set("crime_type")).alias("crime_types"),
            F.max("occurrence_datetime").alias("last_seen"),
        )
    )


def location_visitors(edges: DataFrame, incidents: DataFrame, as_of: Column, days: int) -> DataFrame:
    """People tied to each location through incidents of the last ``days`` days.

    ``edges`` is the graph's edge table, so both legs of the path share the incident id.
    """
    recent = incidents.where(
        (F.datediff(as_of, "occurrence_datetime") <= days) & (F.datediff(as_of, "occurrence_datetime") >= 0)
    ).select(F.col("incident_id").cast("string").alias("source"), "occurrence_datetime")
    live = edges.join(recent, "source")
    places = live.where("relation = 'occurred_at'").select("source", F.col("target").alias("location_id"), "occurrence_datetime")
    people = live.where("relation <> 'occurred_at'").select("source", F.col("target").alias("person_id"), "relation")
    return places.join(people, "source").groupBy("location_id", "person_id", "relation").agg(
        F.count(F.lit(1)).alias("visits"), F.max("occurrence_datetime").alias("last_seen")
    )


def star(incidents: DataFrame, locations: DataFrame, districts: DataFrame) -> DataFrame:
    """Incidents with their location and district; small dimensions are broadcast by the planner."""
    return incidents.join(locations, "location_id", "left").join(districts, "district_id", "left")
