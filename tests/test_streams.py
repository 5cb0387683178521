import json
import os

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from caseweave.operators.hotspots import grid_hotspots
from caseweave.plans import batch, inputs
from caseweave.sources.schemas import INTAKE
from caseweave.streaming import counts, enrich, intake, tables


@pytest.fixture(scope="module")
def slices(spark, tmp_path_factory):
    """The events of the smallest folder in five files by time."""
    folder = str(tmp_path_factory.mktemp("slices"))
    events = inputs.table(spark, f"{DATA}/sf0.001", "events")
    for n in range(5):
        part = events.where((F.dayofmonth("ts") - 1) % 30 >= n * 6).where((F.dayofmonth("ts") - 1) % 30 < n * 6 + 6)
        part.coalesce(1).write.parquet(f"{folder}/{n}")
    return folder, events


def stream(spark, slices, per_batch):
    folder, events = slices
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).parquet(folder)
    return inputs.with_coordinates(inputs.incidents_of_events(raw))


def key(rows):
    return sorted(map(str, rows))


def test_counts_do_not_depend_on_batches(spark, slices, tmp_path):
    results = []
    for per_batch in (1, 5):
        folder = f"{tmp_path}/{per_batch}"
        counts.run_daily_counts(stream(spark, slices, per_batch), folder, f"{folder}/cp")
        results.append(key(counts.current_counts(spark, folder).collect()))
    assert results[0] == results[1] and len(results[0]) > 100
    # Another checkpoint with other batches over the same tables changes nothing.
    counts.run_daily_counts(stream(spark, slices, 3), f"{tmp_path}/1", f"{tmp_path}/1/again")
    assert key(counts.current_counts(spark, f"{tmp_path}/1").collect()) == results[0]


def test_late_rows_are_counted(spark, tmp_path):
    rows = [("2024-03-20", 0), ("2024-03-21", 0), ("2024-03-01", 1), ("2024-03-20", 2)]
    df = spark.createDataFrame([(f"{d} 10:00:00", "D", "T", n) for d, n in rows], "t string, district string, crime_type string, n int").withColumn("occurrence_datetime", F.to_timestamp("t"))
    for n in range(3):
        df.where(F.col("n") == n).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    counts.run_daily_counts(raw, f"{tmp_path}/t", f"{tmp_path}/cp")
    got = {str(r["date"]): r["daily_incidents"] for r in counts.current_counts(spark, f"{tmp_path}/t").collect()}
    assert got == {"2024-03-01": 1, "2024-03-20": 2, "2024-03-21": 1}


def test_intake_judges_every_payload(spark):
    rows = [payload(f"F{k}", kind) for k in range(21) for kind in ("theft", "no such type")] + [payload("F0")]
    schema = spark.read.schema(INTAKE).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    known = spark.createDataFrame([], "offender_id string")
    taken = spark.createDataFrame([], "fir_number string")
    out = intake.judged(schema, known, taken).collect()
    good = [r["fir_number"] for r in out if not r["field_errors"]]
    assert len(out) == 43 and sorted(good) == sorted(f"F{k}" for k in range(21))


def test_enrichment_in_batches_and_on_replay(spark, slices, tmp_path):
    edges, spots = [], []
    for per_batch in (1, 5):
        folder = f"{tmp_path}/{per_batch}"
        enrich.run_enrichment(stream(spark, slices, per_batch), folder, f"{folder}/cp")
        edges.append(key(enrich.current_edges(spark, folder).drop("created_at").collect()))
        found = tables.read_all(spark, folder, "flags").where("flag_type = 'HOTSPOT'")
        spots.append(sorted(r["target_id"] for r in found.collect()))
    everything = inputs.geo_incidents(spark, f"{DATA}/sf0.001")
    assert edges[0] == edges[1] and len(edges[0]) == everything.count()
    assert spots[0] == spots[1] == sorted(r["hotspot_id"] for r in grid_hotspots(everything).collect())
    # A second run over the same files with a new checkpoint replays every batch.
    folder = f"{tmp_path}/1"
    before = key(tables.read_all(spark, folder, "flags").drop("created_at").collect())
    enrich.run_enrichment(stream(spark, slices, 1), folder, f"{folder}/cp2")
    assert key(enrich.current_edges(spark, folder).drop("created_at").collect()) == edges[0]
    again = tables.read_all(spark, folder, "flags").drop("created_at")
    assert sorted(r["flag_id"] for r in again.collect()) == sorted(set(r["flag_id"] for r in again.collect())) and len(before) == again.count()


def test_a_decided_target_is_flagged_again(spark, slices, tmp_path):
    """Once all flags so far were dismissed, the next batch may raise its targets again, under ids of their own."""
    folder = str(tmp_path / "t")

    def dismissed():
        flags = tables.read_all(spark, folder, "flags")
        return flags.select("flag_id", F.lit("DISMISS").alias("decision"), F.lit("no").alias("reason"), "created_at", F.col("flag_id").alias("decision_id"))

    enrich.run_enrichment(stream(spark, slices, 1), folder, f"{folder}/cp", decisions=dismissed)
    again = tables.read_all(spark, folder, "flags")
    assert again.count() == again.select("flag_id").distinct().count()
    assert again.groupBy("target_id").count().where("count > 1").count() > 0


def payload(number, kind="theft", **more):
    return {
        "fir_number": number, "incident_type": kind, "reported_at": "2024-01-02", "occurred_at": "2024-01-01", "narrative_text": "", "created_by": "u",
        "location": {"latitude": 1.0, "longitude": 2.0, "district_id": "3"}, "offenders": [], "victims": [], **more,
    }


def test_intake(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    first = [payload("F1", offenders=[{"offender_id": "o1"}, {"name": "new"}], victims=[{"name": "v"}]), payload("F2", "arson"), payload("F3", offenders=[{"offender_id": "o9"}])]
    second = [payload("F1"), payload("F4"), payload("F4")]
    for n, rows in enumerate((first, second)):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken oldest first
    known = spark.createDataFrame([("o1",)], "offender_id string")
    raw = spark.readStream.schema(INTAKE).option("maxFilesPerTrigger", 1).json(str(source))
    intake.run_intake(raw, known, f"{tmp_path}/t", f"{tmp_path}/cp")
    stored = tables.read_all(spark, f"{tmp_path}/t", "incidents")
    rejected = tables.read_all(spark, f"{tmp_path}/t", "rejected")
    reasons = {(r["fir_number"], e["message"]) for r in rejected.collect() for e in r["field_errors"]}
    assert ("F3", "offender_id o9 not found") in reasons and ("F1", "already recorded") in reasons
    assert sorted(r["fir_number"] for r in stored.collect()) == ["F1", "F4"]
    assert tables.read_all(spark, f"{tmp_path}/t", "incident_offenders").count() == 2
    assert tables.read_all(spark, f"{tmp_path}/t", "offenders").count() == 1


def test_tag_matches_in_the_stream(spark, tmp_path):
    rows = [(i, "D", "T", "2024-01-01", f"S{i}", i, 1.0 + i, 2.0, tags) for i, tags in enumerate([["a", "b"], ["a", "b"], ["a", "c"], ["z"]])]
    schema = "incident_id int, district string, crime_type string, occurrence_datetime string, police_station string, offender_id int, latitude double, longitude double, mo_tags array<string>"
    df = spark.createDataFrame(rows, schema).withColumn("occurrence_datetime", F.to_timestamp("occurrence_datetime"))
    for n in range(2):
        df.where(F.col("incident_id") % 2 == n).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    enrich.run_enrichment(raw, f"{tmp_path}/t", f"{tmp_path}/cp")
    edges = tables.read_all(spark, f"{tmp_path}/t", "mo_edges")
    assert {frozenset((r["source"], r["target"])) for r in edges.collect()} == {frozenset((0, 1))}
    assert tables.read_all(spark, f"{tmp_path}/t", "flags").where("flag_type = 'MO_LINK'").count() == 1


def test_batch_job(spark, tmp_path):
    geo = inputs.geo_incidents(spark, f"{DATA}/sf0.001").withColumn("modus_operandi", F.col("status"))
    status, summary = batch.run_batch(spark, geo, str(tmp_path / "out"), min_samples=3, feature_columns=["property_loss", "status"])
    rows = {r["module"]: r["status"] for r in summary.collect()}
    assert status == "completed" and rows["final"] == "completed" and rows["risk"] == "success"
    assert spark.read.parquet(str(tmp_path / "out" / "risk_scores")).count() == 10
    status, summary = batch.run_batch(spark, geo.drop("latitude", "modus_operandi"), str(tmp_path / "half"), feature_columns=["property_loss"])
    rows = {r["module"]: r["status"] for r in summary.collect()}
    assert status == "partial_success" and rows["hotspot"] == "failed" and rows["risk"] == "skipped"
    with pytest.raises(Exception):
        batch.run_batch(spark, geo.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none" / "run_summary").exists()


@pytest.mark.parametrize("statuses,want", [(["success"] * 3, "completed"), (["success", "skipped"], "partial_success"), (["failed", "skipped"], "failed")])
def test_overall_status(statuses, want):
    assert batch.overall_status(statuses) == want
