import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caseweave.operators.checks import InputError
from caseweave.sources import cache, readers, store, writers


def at(text):
    return F.lit(text).cast("timestamp")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string")
    path = writers.write_table(df, str(tmp_path / "t"), "csv")
    assert sorted(map(tuple, readers.read_required_csv(spark, path, "t", "a string, b string").collect()), key=str) == [("1", "x"), ("2", None)]
    with pytest.raises(InputError):
        readers.read_required_csv(spark, str(tmp_path / "absent"), "t", "a string")
    assert readers.read_optional_csv(spark, str(tmp_path / "absent"), "a string") is None
    (tmp_path / "none.csv").write_text("weapon_used\nNone\nKnife\n")
    assert [r[0] for r in readers.read_csv(spark, str(tmp_path / "none.csv"), "weapon_used string").collect()] == [None, "Knife"]
    assert [r[0] for r in readers.read_csv(spark, str(tmp_path / "none.csv"), "weapon_used string", "").collect()] == ["None", "Knife"]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert json.loads(writers.as_json_lines(df).first()["value"]) == {"a": 1, "b": None, "c": None}
    (tmp_path / "r.json").write_text(json.dumps([{"fir_number": "F", "case_type": "Theft", "created_at": "2024-01-02T03:04:05Z"}]))
    got = readers.map_live_incidents(readers.read_json_records(spark, str(tmp_path / "r.json"))).first()
    assert (got["incident_id"], got["crime_type"], got["district"]) == ("F", "Theft", "UNKNOWN")
    assert got["occurrence_datetime"] == datetime(2024, 1, 2, 3, 4, 5)


def test_write_outputs_skips_absent(spark, tmp_path):
    df = spark.range(3)
    assert set(writers.write_outputs({"x": df, "y": None}, str(tmp_path))) == {"x"}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.seed({"t": spark.createDataFrame([(1, "a", datetime(2024, 1, 1), datetime(2024, 1, 1))], "id int, v string, created_at timestamp, updated_at timestamp")})
    s.insert("t", spark.createDataFrame([(2, "b", None, None)], "id int, v string, created_at timestamp, updated_at timestamp"), at("2024-02-01"))
    assert [r["id"] for r in s.find_many("t", id=2).collect()] == [2]
    assert [r["id"] for r in s.find_many("t", limit=1).collect()] == [2]
    assert s.find_one("t", "id", "1").first()["v"] == "a" and s.find("t", F.col("v") == "z").isEmpty()
    change = store.patched(store.latest_rows(s.read("t"), ["id"]), spark.createDataFrame([(1, "c")], "id int, v string"), "id", at("2024-03-01"))
    s.update("t", change, at("2024-03-01"))
    assert sorted((r["id"], r["v"]) for r in store.latest_rows(s.read("t"), ["id"]).collect()) == [(1, "c"), (2, "b")]


def test_stamped_ids_are_repeatable(spark):
    df = spark.createDataFrame([("x",)], "v string")
    assert store.stamped(df, at("2024-01-01"), "row_id").first()["row_id"] == store.stamped(df, at("2024-05-01"), "row_id").first()["row_id"]


def test_edge_weight_adds_on_repeat_only(spark):
    df = spark.createDataFrame([("i1", "a", "b"), ("i2", "a", "b")], "i string, s string, t string")
    rows = store.edge_rows(df, F.col("i"), F.col("s"), F.col("t"), F.lit("r"), at("2024-01-01"))
    assert {r["weight"] for r in store.upsert_edges(rows, rows).collect()} == {2.0}
    assert {r["weight"] for r in store.upsert_edges(rows, rows, add_weight=False).collect()} == {1.0}
    assert store.cross_incident_edges(rows.unionByName(rows)).first()["weight"] == 2


def test_cache(spark):
    df = spark.createDataFrame([("k", '{"a":1,"n":{"x":2}}'), ("bad", "{")], "k string, p string")
    c = cache.entries(df, F.col("k"), F.col("p"), at("2024-01-01"), 60)
    assert [r["cache_key"] for r in cache.get(c, at("2024-01-01 00:00:30")).collect()] == ["k"]
    assert cache.get(c, at("2024-01-01 00:01:00")).isEmpty()
    change = spark.createDataFrame([("k", '{"a":5,"b":6}'), ("new", '{"z":1}')], "cache_key string, payload string")
    merged = cache.put(c, cache.patch(c, change, at("2024-01-01 00:00:30")))
    live = {r["cache_key"]: json.loads(r["payload"]) for r in cache.get(merged, at("2024-01-01 00:00:40")).collect()}
    assert live["k"]["a"] == "5" and live["k"]["b"] == "6" and json.loads(live["k"]["n"]) == {"x": 2} and live["new"]["z"] == "1"
    assert cache.delete(merged, spark.createDataFrame([("k",)], "cache_key string")).where("cache_key = 'k'").isEmpty()
