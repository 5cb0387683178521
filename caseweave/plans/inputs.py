"""Incident-shaped views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import lookup


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Incident type and status assigned to each event type and event number.
EVENT_CRIMES = {"view": "Theft", "click": "Burglary", "signup": "Assault", "purchase": "Fraud", "error": "Robbery"}
EVENT_STATUSES = {0: "OPEN", 1: "UNDER_INVESTIGATION", 2: "CLOSED", 3: "CLOSED"}
ORDER_STATUSES = {"O": "open", "P": "under_review", "F": "closed"}


def event_incidents(spark: SparkSession, folder: str) -> DataFrame:
    return incidents_of_events(table(spark, folder, "events"))


def incidents_of_events(events: DataFrame) -> DataFrame:
    """Works on the stored table and on a stream of it."""
    return events.select(
        F.col("event_id").alias("incident_id"),
        lookup(EVENT_CRIMES, F.col("event_type")).alias("crime_type"),
        F.concat(F.lit("D"), (F.col("user_id") % 10).cast("string")).alias("district"),
        F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("police_station"),
        F.col("ts").alias("occurrence_datetime"),
        F.col("user_id").alias("offender_id"),
        F.col("value").alias("property_loss"),
        lookup(EVENT_STATUSES, (F.col("event_id") % 4).cast("int")).alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def geo_incidents(spark: SparkSession, folder: str) -> DataFrame:
    return with_coordinates(event_incidents(spark, folder))


def with_coordinates(incidents: DataFrame) -> DataFrame:
    """Event incidents with coordinates: one dense core per district in a sparse surrounding."""
    u1 = F.pmod(F.col("incident_id") * 7919, F.lit(10007)).cast("double") / F.lit(10007.0)
    u2 = F.pmod(F.col("incident_id") * 104729, F.lit(10009)).cast("double") / F.lit(10009.0)
    scale = F.when(F.col("incident_id") % 20 == 0, 0.004).otherwise(0.3)
    d = (F.col("offender_id") % 10).cast("double")
    return incidents.withColumns(
        {
            "latitude": F.lit(12.0) + d * 0.7 + (u1 - 0.5) * scale,
            "longitude": F.lit(75.0) + d * 0.3 + (u2 - 0.5) * scale,
        }
    )


def order_incidents(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer")
    n = table(spark, folder, "nation")
    places = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        "c_custkey", F.col("n_name").alias("district"), "c_mktsegment"
    )
    repeat = o.groupBy("o_custkey").agg((F.count(F.lit(1)) >= 10).alias("repeat_offender"))
    return (
        o.join(places, F.col("o_custkey") == F.col("c_custkey"))
        .join(repeat, "o_custkey")
        .select(
            F.col("o_orderkey").alias("incident_id"),
            F.col("o_orderpriority").alias("crime_type"),
            "district",
            F.col("o_orderdate").alias("occurrence_datetime"),
            F.col("o_custkey").alias("offender_id"),
            F.col("o_totalprice").alias("property_loss"),
            lookup(ORDER_STATUSES, F.col("o_orderstatus")).alias("status"),
            "repeat_offender",
            F.col("c_mktsegment").alias("segment"),
        )
    )


def order_victims(spark: SparkSession, folder: str) -> DataFrame:
    """Incident-victim bridge."""
    return (
        table(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("incident_id"), F.col("l_suppkey").alias("victim_id"))
        .distinct()
    )


def part_cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("incident_id"),
        F.col("p_brand").alias("crime_type"),
        F.col("p_name").alias("modus_operandi"),
        F.col("p_type").alias("weapon_used"),
        F.split("p_name", " ").alias("mo_tags"),
    )


def document_cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("incident_id"), F.col("lang").alias("crime_type"), F.col("text").alias("narrative")
    )


# Flag fields assigned to each event.
EVENT_FLAG_TYPES = {"view": "HOTSPOT", "click": "MO_LINK", "signup": "ANOMALY", "purchase": "EMERGING_TREND", "error": "RISK_SCORE"}
EVENT_FLAG_STATUSES = {0: "PENDING", 1: "ACKNOWLEDGED", 2: "ESCALATED", 3: "DISMISSED"}


def event_flags(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("value")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("flag_id"),
        lookup(EVENT_FLAG_TYPES, F.col("event_type")).alias("flag_type"),
        F.when(v >= 150, "CRITICAL").when(v >= 75, "HIGH").when(v >= 25, "MEDIUM").otherwise("LOW").alias("severity"),
        F.concat(F.lit("Alert "), F.col("event_type"), F.lit(" S"), (F.col("user_id") % 50).cast("string")).alias("title"),
        (v / 500.0).alias("confidence_score"),
        lookup(EVENT_FLAG_STATUSES, (F.col("event_id") % 4).cast("int")).alias("status"),
        F.concat(F.lit("T"), (F.col("user_id") % 50).cast("string")).alias("target_id"),
        F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("jurisdiction_id"),
        F.col("ts").alias("created_at"),
    )


def event_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Two decisions for every flag, one hour and two hours after it was raised."""
    e = table(spark, folder, "events")
    choices = {0: "ACKNOWLEDGE", 1: "ESCALATE", 2: "DISMISS"}
    return e.select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("step")).select(
        (F.col("event_id") * 2 + F.col("step")).alias("decision_id"),
        F.col("event_id").alias("flag_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("reviewer_id"),
        lookup(choices, ((F.floor(F.col("event_id") / 3) + F.col("step")) % 3).cast("int")).alias("decision"),
        F.concat(F.lit("reason "), F.col("step").cast("string")).alias("reason"),
        (F.col("ts") + F.make_dt_interval(hours=F.col("step"))).alias("created_at"),
    )


def event_case_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Event incidents with person ids that cannot be mistaken for incident ids."""
    e = event_incidents(spark, folder)
    return e.withColumn("offender_id", F.concat(F.lit("U"), F.col("offender_id").cast("string")))


def order_case_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(order incidents with one offender, victim bridge naming the suppliers of each order)."""
    victims = order_victims(spark, folder).select(
        "incident_id", F.concat(F.lit("V"), F.col("victim_id").cast("string")).alias("victim_id")
    )
    offender = F.concat(F.lit("C"), F.col("offender_id").cast("string"))
    return order_incidents(spark, folder).withColumn("offender_id", offender), victims


def unclean_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Event incidents as text columns with unparsable, out-of-range and missing values among them."""
    e = event_incidents(spark, folder)
    i, k = F.col("incident_id"), F.col("k")
    return e.select(
        F.when(i % 31 != 0, i).alias("incident_id"),
        "crime_type",
        "district",
        F.when(i % 17 == 0, "north").otherwise(k.cast("string")).alias("latitude"),
        F.when(i % 19 != 0, (k * 2).cast("string")).alias("longitude"),
        F.when(i % 29 == 0, "unknown").otherwise("2024-01-15 10:00:00").alias("occurrence_datetime"),
    )


def intake_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Events as intake payloads, some of them breaking several rules at once."""
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    i, k = F.col("event_id"), F.col("k")
    kinds = {"view": "theft", "click": "burglary", "signup": "loitering", "purchase": "fraud", "error": "robbery"}
    return e.select(
        i.alias("event_id"),
        F.when(k < 5, " ").otherwise(F.concat(F.lit("F-"), i.cast("string"))).alias("fir_number"),
        lookup(kinds, F.col("event_type")).alias("incident_type"),
        F.when(i % 7 == 0, "soon").otherwise("2024-02-01 08:00:00").alias("reported_at"),
        F.lit("2024-01-31 22:00:00").alias("occurred_at"),
        F.when(i % 11 != 0, "officer").alias("created_by"),
        F.when(
            i % 13 != 0,
            F.struct(
                k.cast("double").alias("latitude"),
                (k * 2).cast("double").alias("longitude"),
                F.when(i % 5 == 0, "x").otherwise("7").alias("district_id"),
                F.lit(None).cast("string").alias("address_text"),
            ),
        ).alias("location"),
        F.lit(None).cast("array<struct<offender_id:string,name:string,aliases:string,role_in_incident:string>>").alias("offenders"),
        F.lit(None).cast("array<struct<victim_id:string,name:string,contact_info:string>>").alias("victims"),
    )


def case_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as nested case documents with one section per order line."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("l_returnflag").alias("ActID"),
                    F.col("l_partkey").cast("string").alias("SectionID"),
                    F.col("l_linenumber").alias("ActOrderID"),
                    F.lit(1).alias("SectionOrderID"),
                )
            )
        ).alias("ActSectionAssociation")
    )
    o = table(spark, folder, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("CaseMasterID"),
        F.concat(F.lit("CN-"), F.col("o_orderkey").cast("string")).alias("CaseNo"),
        F.col("o_orderpriority").alias("DistrictName"),
        F.col("o_orderstatus").alias("PoliceStationName"),
        F.col("o_orderdate").alias("IncidentFromDate"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(30))).alias("InfoReceivedPSDate"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        F.lit("").alias("BriefFacts"),
        F.split("o_orderpriority", "-").alias("mo_tags"),
        F.struct(
            F.col("o_custkey").alias("AccusedMasterID"),
            F.concat(F.lit("Name "), F.col("o_custkey").cast("string")).alias("AccusedName"),
            (F.col("o_totalprice") > 200000).alias("prior_record_flag"),
            F.lit(1).alias("prior_cases_count"),
        ).alias("Accused"),
        F.struct(F.lit(None).cast("bigint").alias("VictimMasterID")).alias("Victim"),
        "ActSectionAssociation",
    )
