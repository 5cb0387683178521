"""Ordered results, adjacency lookups, sketches and the per-fold encoder."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from caseweave.operators import adjacency, graph, risk_model, sketches
from caseweave.sources.ordered import ORDERS, order_of, page, read_ordered, write_ordered

DICE = random.Random(8)


def test_positions_and_pages(spark, tmp_path):
    rows = [(f"f{i:03d}", DICE.choice([None, 1, 2, 3, 50])) for i in range(400)]
    frame = spark.createDataFrame(rows, "flag_id string, risk_score int").repartition(7)
    order = [F.col("risk_score").desc_nulls_last(), F.col("flag_id").asc()]
    folder = write_ordered(frame, str(tmp_path / "t"), order)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = sorted((r.position, r.flag_id) for r in read_ordered(spark, folder).collect())
    assert got == [(n, r[0]) for n, r in enumerate(want, 1)]
    for first, size in ((1, 3), (200, 60), (399, 10), (401, 5)):
        assert [r.flag_id for r in page(spark, folder, first, size).collect()] == [r[0] for r in want[first - 1 : first - 1 + size]]
    assert len(page(spark, folder, 1, 1).inputFiles()) <= 2  # one of the rows, one of the counts
    empty = write_ordered(frame.limit(0), str(tmp_path / "none"), order)
    assert read_ordered(spark, empty).isEmpty() and page(spark, empty, 1, 5).isEmpty()
    assert all(len(order_of(t)) == len(ORDERS[t].split(",")) for t in ORDERS)


@pytest.mark.parametrize("listed", [500, 0])
def test_hops_by_adjacency(spark, listed):
    edges = [(f"n{DICE.randrange(60)}", f"n{DICE.randrange(60)}", DICE.choice("rs"), 1) for _ in range(90)] + [("n1", "n1", "r", 1), (None, "n2", "r", 1)]
    frame = spark.createDataFrame(edges, "source string, target string, relation string, weight int").distinct()
    start = spark.createDataFrame([("n1",), ("n2",), ("unknown",)], "id string")
    name = adjacency.store_adjacency(frame, 4)
    known = frame.where("source is not null")
    for hops in (0, 1, 3):
        visited, found = adjacency.k_hop(spark, name, start, hops, listed=listed)
        want, want_edges = graph.k_hop(known, start, hops)
        assert sorted(map(tuple, visited.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, found.where("source is not null").collect())) == sorted(map(tuple, want_edges.collect()))


def test_a_hop_moves_no_edge(spark):
    edges = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("source"), F.concat(F.lit("b"), F.col("id") % 50).alias("target"), F.lit("r").alias("relation"), F.lit(1).alias("weight"))
    name = adjacency.store_adjacency(edges, 8)
    start = spark.createDataFrame([("b1",)], "id string")
    short = adjacency.neighbours(spark, name, start)
    assert short.count() == 40 and short.rdd.getNumPartitions() < spark.table(name).rdd.getNumPartitions()  # the files of one bucket
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = adjacency.neighbours(spark, name, edges.select(F.col("target").alias("id")), listed=0)
        plan = long._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
        stored = plan[plan.index("SortMergeJoin") : plan.index("FileScan")]
        assert "Exchange" not in stored and "Bucketed: true" in plan  # only the frontier is dealt
        assert long.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_merge(spark):
    rows = [(f"2024-01-{1 + i % 20:02d}", "D" if i % 3 else "E", i % 137, float(i % 1000)) for i in range(6000)] + [("2024-01-02", "D", None, None), (None, None, 1, 1.0)]
    frame = spark.createDataFrame(rows, "t string, district string, offender_id int, property_loss double").withColumn("occurrence_datetime", F.to_timestamp("t"))
    daily = sketches.daily_sketches(frame)
    assert daily.count() == 41
    twice = sketches.merged(sketches.merged(daily, "date", "district"), "district")
    got = {r.district: r for r in sketches.estimates(twice).collect()}
    for d in ("D", "E"):
        mine = sorted(x[3] for x in rows if x[1] == d and x[3] is not None)
        assert abs(got[d].distinct_people - len({x[2] for x in rows if x[1] == d and x[2] is not None})) <= 6
        assert got[d].incidents == sum(x[1] == d for x in rows)
        for q, p in zip(got[d].quantiles, (1 / 3, 0.5, 2 / 3)):
            assert abs(sum(v <= q for v in mine) / len(mine) - p) < 0.03
    nothing = spark.createDataFrame([("2024-01-01", "Z", 1, None)], frame.select("t", "district", "offender_id", "property_loss").schema).withColumn("occurrence_datetime", F.to_timestamp("t"))
    assert sketches.estimates(sketches.daily_sketches(nothing)).first().quantiles is None


def test_held_out_targets_never_reach_the_features(spark):
    """Other targets and losses of held-out rows leave every feature as it was."""
    rows = [(i, 0.1 * (i % 7), "abc"[i % 3], float(i % 5), i % 2 * 1.0, float(i % 90), "Night", float(i % 2), "HIGH" if i % 3 else "LOW") for i in range(600)]
    schema = "incident_id int, station_ratio double, category string, spatial_density_1km double, prior_offender double, property_loss double, time_bucket string, target double, label string"
    frame = spark.createDataFrame(rows, schema)
    out = F.col("incident_id").isin([r.incident_id for r in frame.where(risk_model.held_out(F.col("incident_id"))).collect()])
    other = frame.withColumns({"target": F.when(out, 1000.0).otherwise(F.col("target")), "property_loss": F.when(out, F.col("property_loss") + 1e6).otherwise(F.col("property_loss"))})
    fitted = []
    for rows_ in (frame, other):
        stages = risk_model.model_stages(RandomForestClassifier(labelCol="_label", featuresCol="_x", numTrees=2, seed=1))
        model = Pipeline(stages=stages[:-1]).fit(rows_.where(~risk_model.held_out(F.col("incident_id"))))
        fitted.append([(r.incident_id, r._x) for r in model.transform(frame).orderBy("incident_id").collect()])
    assert fitted[0] == fitted[1]
    assert 60 < frame.where(risk_model.held_out(F.col("incident_id"))).count() < 180
