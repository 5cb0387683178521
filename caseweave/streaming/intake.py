"""Intake: validate, split, and append with deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quality import intake_rules, violations
from ..operators.scale import materialize
from ..sources.keyed import KeyedTable, compact_every
from .tables import STATE_STORE, prepare, run_available, settings, write_batch

COMPACT_EVERY = 8

TABLES = {
    "incidents": "incident_id string, fir_number string, incident_type string, location_id string, reported_at timestamp, "
    "occurred_at timestamp, narrative_text string, status string, created_by string",
    "locations": "location_id string, district_id bigint, latitude double, longitude double, address_text string",
    "incident_offenders": "incident_id string, offender_id string, role_in_incident string",
    "incident_victims": "incident_id string, victim_id string",
    "offenders": "offender_id string, name string, aliases string",
    "victims": "victim_id string, name string, contact_info string",
}


def _key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256))


def judged(payloads: DataFrame, known_offenders: DataFrame, known_numbers: DataFrame) -> DataFrame:
    """Every payload with all its field errors: the row rules, offender ids that do not exist, and numbers that were taken before.

    Among the faultless payloads of one number the first by content is accepted; the others, also equal ones, are rejected as recorded.
    ``payloads`` must not change between reads, for rows are told apart by their place.
    """
    content = F.sha2(F.to_json(F.struct(*payloads.columns)), 256)
    rows = violations(payloads, intake_rules()).withColumn("_row", F.struct(content.alias("content"), F.monotonically_increasing_id().alias("place")))
    named = rows.select("_row", F.explode("offenders.offender_id").alias("offender_id")).where("offender_id IS NOT NULL")
    missing = named.join(known_offenders.select("offender_id").distinct(), "offender_id", "left_anti").groupBy("_row").agg(
        F.min("offender_id").alias("_missing")
    )
    taken = known_numbers.select("fir_number").distinct().withColumn("_taken", F.lit(True))
    joined = rows.join(missing, "_row", "left").join(taken, "fir_number", "left")
    faultless = (F.size("field_errors") == 0) & F.col("_missing").isNull() & F.col("_taken").isNull()
    first = joined.where(faultless).groupBy("fir_number").agg(F.min("_row").alias("_first"))
    placed = joined.withColumn("_faultless", faultless).join(first, "fir_number", "left")
    again = F.coalesce("_taken", F.lit(False)) | (F.col("_faultless") & (F.col("_row") != F.col("_first")))
    extra = F.array_compact(
        F.array(
            F.when(F.col("_missing").isNotNull(), F.struct(F.lit("offenders").alias("field"), F.concat(F.lit("offender_id "), "_missing", F.lit(" not found")).alias("message"))),
            F.when(again, F.struct(F.lit("fir_number").alias("field"), F.lit("already recorded").alias("message"))),
        )
    )
    return placed.withColumn("field_errors", F.concat("field_errors", extra)).drop("_missing", "_taken", "_first", "_faultless")


def accepted_tables(valid: DataFrame) -> dict[str, DataFrame]:
    """Rows for each stored table. People without an id get one derived from the incident and their
    place in the list."""
    base = valid.withColumns(
        {
            "incident_id": _key("INC_", F.col("fir_number")),
            "location_id": _key("LOC_", F.col("location.latitude"), F.col("location.longitude"), F.col("location.district_id"), F.col("location.address_text")),
        }
    )
    o = base.select("incident_id", F.posexplode("offenders").alias("i", "p")).withColumn(
        "offender_id", F.coalesce("p.offender_id", _key("OFF_", F.col("incident_id"), F.col("i")))
    )
    v = base.select("incident_id", F.posexplode("victims").alias("i", "p")).withColumn(
        "victim_id", F.coalesce("p.victim_id", _key("VIC_", F.col("incident_id"), F.col("i")))
    )
    return {
        "incidents": base.select(
            "incident_id", "fir_number", "incident_type", "location_id", F.try_to_timestamp("reported_at").alias("reported_at"),
            F.try_to_timestamp("occurred_at").alias("occurred_at"), F.coalesce("narrative_text", F.lit("")).alias("narrative_text"),
            F.lit("open").alias("status"), "created_by",
        ),
        "locations": base.select(
            "location_id", F.col("location.district_id").try_cast("bigint").alias("district_id"), "location.latitude", "location.longitude", "location.address_text"
        ).dropDuplicates(["location_id"]),
        "incident_offenders": o.select("incident_id", "offender_id", F.coalesce("p.role_in_incident", F.lit("suspect")).alias("role_in_incident")),
        "incident_victims": v.select("incident_id", "victim_id"),
        "offenders": o.where("p.offender_id IS NULL").select("offender_id", "p.name", "p.aliases"),
        "victims": v.where("p.victim_id IS NULL").select("victim_id", "p.name", "p.contact_info"),
    }


def first_deliveries(payloads: DataFrame, within: str) -> DataFrame:
    """Payloads without those of equal content that came again within a time, in one batch or in several. The state is a digest per payload that came
    within it. A row's time is that of its batch, so none is ever late."""
    content = F.sha2(F.to_json(F.struct(*payloads.columns)), 256)
    timed = payloads.withColumns({"_content": content, "_received": F.current_timestamp()}).withWatermark("_received", within)
    return timed.dropDuplicatesWithinWatermark(["_content"]).drop("_content", "_received")


def run_intake(payloads: DataFrame, known_offenders: DataFrame, folder: str, checkpoint: str, within: str = "1 day") -> None:
    """Validate each batch; accepted rows go to the tables, the rest to ``rejected``.

    Deliveries of the same payload within the time ``within`` are dropped by the stream's state. What passes is checked exactly: case numbers and
    people of earlier batches are keyed tables, of which a batch opens the buckets of its own numbers and people.
    """
    spark = payloads.sparkSession
    prepare(spark, folder, TABLES)
    numbers, people = (KeyedTable(spark, f"{folder}/known_{key}s", f"{key} string, n bigint", [key], lambda: [F.sum("n").alias("n")]) for key in ("fir_number", "offender_id"))

    def apply(df: DataFrame, batch: int) -> None:
        compact_every([numbers, people], batch, COMPACT_EVERY)
        rows = materialize(df)
        named = rows.select(F.explode("offenders.offender_id").alias("offender_id")).where("offender_id is not null")
        offenders = known_offenders.select("offender_id").unionByName(people.lookup(named, batch - 1).select("offender_id"))
        checked = materialize(judged(rows, offenders, numbers.lookup(rows.select("fir_number"), batch - 1)))
        bad = F.size("field_errors") > 0
        write_batch(checked.where(bad).drop("_row"), folder, "rejected", batch)
        accepted = accepted_tables(checked.where(~bad))
        for table, found in accepted.items():
            write_batch(found, folder, table, batch)
        count = F.count(F.lit(1)).alias("n")
        numbers.append(accepted["incidents"].groupBy("fir_number").agg(count), batch)
        people.append(accepted["offenders"].groupBy("offender_id").agg(count), batch)

    with settings(spark, STATE_STORE):
        run_available(first_deliveries(payloads, within).writeStream.foreachBatch(apply), checkpoint)
