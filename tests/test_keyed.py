"""Keyed tables: merge on read, compaction by bucket, replays."""

from datetime import datetime
from glob import glob

import pytest
from pyspark.sql import functions as F

from caseweave.sources import store
from caseweave.sources.keyed import Files, KeyedTable

SCHEMA = "id bigint, kind string, n bigint, first timestamp"


def at(day):
    return datetime(2024, 1, day)


def table(spark, folder, buckets=8):
    return KeyedTable(spark, str(folder), SCHEMA, ["id", "kind"], lambda: [F.sum("n").alias("n"), F.min("first").alias("first")], ["id"], buckets)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(folder, part):
    return set(glob(f"{folder}/{part}/*/bucket=*/*.parquet"))


def test_reading_merges_before_and_after_compaction(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows_of(t.read()) == []
    batches = [[(k, "a", 1, at(1 + n)) for k in range(n, 40, n + 1)] + [(None, "z", 1, at(9 - n)), (None, None, 2, None)] for n in range(4)]
    twin = batch(spark, [])
    for n, rows in enumerate(batches):
        t.append(batch(spark, rows + rows[:3]), n)
        twin = twin.unionByName(batch(spark, rows + rows[:3]))
        expected = rows_of(t.merged(twin))
        assert rows_of(t.read()) == expected
        if n % 2:
            t.compact()
            assert rows_of(t.read()) == expected and not t._deltas(t.manifest()["through"])
    wanted = spark.createDataFrame([(3,), (7,), (999,), (3,)], "id bigint")
    assert rows_of(t.lookup(wanted)) == [r for r in expected if r[0] in (3, 7)]


def test_compaction_rewrites_only_touched_buckets(spark, tmp_path):
    t = table(spark, tmp_path, 64)
    t.append(spark.range(10_000).select("id", F.lit("a").alias("kind"), F.lit(1).cast("bigint").alias("n"), F.lit(at(1)).alias("first")), 0)
    assert len(t.compact()) == 64
    before = files(tmp_path, "base")
    few = batch(spark, [(k, "a", 1, at(2)) for k in range(0, 10_000, 1000)])
    t.append(few, 1)
    touched = t.compact()
    assert 0 < len(touched) <= 10
    new = files(tmp_path, "base") - before
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == set(touched) and len(new) == len(touched)
    assert rows_of(t.read().groupBy("n").count()) == [(1, 9990), (2, 10)]
    t.append(few, 2)
    t.compact()
    live = {(int(b), v) for b, v in t.manifest()["buckets"].items()}
    kept = {(int(f.split("bucket=")[1].split("/")[0]), int(f.split("version=")[1].split("/")[0])) for f in files(tmp_path, "base")}
    assert live <= kept and not glob(f"{tmp_path}/delta/batch=0/*")  # what two manifests ago was needed is gone


def test_replays_add_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    for n in range(3):
        t.append(batch(spark, [(n, "a", 1, at(1)), (9, "a", 1, at(1))]), n)
    expected = rows_of(t.read())
    t.append(batch(spark, [(2, "a", 1, at(1)), (9, "a", 1, at(1))]), 2)  # not merged yet: replaced
    assert rows_of(t.read()) == expected and dict((r[0], r[2]) for r in expected)[9] == 3
    t.compact(1)
    assert rows_of(t.read()) == expected
    t.append(batch(spark, [(1, "a", 1, at(1)), (9, "a", 1, at(1))]), 1)  # merged already: skipped
    assert rows_of(t.read()) == expected
    assert rows_of(t.read(1)) == [(0, "a", 1, at(1)), (1, "a", 1, at(1)), (9, "a", 2, at(1))]
    t.append(batch(spark, [(5, "b", 1, at(1))]), 0)  # a new stream
    assert rows_of(t.read()) == [(5, "b", 1, at(1))]


def test_publishing_is_all_or_nothing(spark, tmp_path):
    files_ = Files(spark, str(tmp_path))
    files_.publish(f"{tmp_path}/m/1.json", "{}")
    with pytest.raises(RuntimeError):
        files_.publish(f"{tmp_path}/m/1.json", "[]")
    assert files_.read(f"{tmp_path}/m/1.json") == "{}" and len(files_.names(f"{tmp_path}/m/*")) == 1


def test_edges_equal_the_batch_twin(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 40).cast("string").alias("i"), (F.col("id") % 7).cast("string").alias("s"), F.lit("t").alias("t"), (F.col("id") % 5).alias("b"))
    rows = store.edge_rows(df, F.col("i"), F.col("s"), F.col("t"), F.lit("r"), F.lit(at(1))).withColumn("b", F.lit(0))
    schema = rows.drop("b").schema
    t = KeyedTable(spark, str(tmp_path), schema, store.EDGE_KEYS, store.edge_merge, buckets=4)
    for n in range(3):
        t.append(rows.drop("b"), n)
    t.compact(1)
    twin = store.upsert_edges(rows.drop("b"), rows.drop("b").unionByName(rows.drop("b")))
    assert rows_of(t.read()) == rows_of(twin.select(*schema.names))
