"""Steps that run once or in few rounds, however many rows there are."""

from pyspark.sql import functions as F

from caseweave.operators import components, dbscan
from caseweave.plans.catalog import lookups, scores, streams


def test_what_hangs_on_hubs_is_gone_after_few_rounds(spark, monkeypatch):
    writes = []

    def counted(df):
        writes.append(1)
        return materialize(df)

    materialize = components.materialize
    monkeypatch.setattr(components, "materialize", counted)
    links = [(f"{i}", f"L{i % 3}") for i in range(600)] + [(f"{i}", f"U{i % 30}") for i in range(600)] + [("0", "L0"), ("x", "x"), ("L1", "y")]
    edges = spark.createDataFrame(links, "s string, t string")
    nodes = edges.select(F.explode(F.array("s", "t")).alias("node")).union(spark.createDataFrame([("alone",)], "node string"))
    got = {r["node"]: r["component"] for r in components.connected_components(edges, nodes, "s", "t", "node").collect()}
    least = [min(f"{i}" for i in range(k, 600, 3)) for k in range(3)]
    placed = {**{f"{i}": least[i % 3] for i in range(600)}, **{f"L{i}": least[i] for i in range(3)}, **{f"U{i}": least[i % 3] for i in range(30)}}
    assert got == {**placed, "x": "x", "y": least[1], "alone": "alone"}
    assert len(writes) <= 8


def test_slices_of_a_stream_share_their_edges(spark, monkeypatch):
    plans = []

    def looked_at(_, slices, *rest):
        plans.extend(s._jdf.queryExecution().toString() for s in slices)
        raise StopIteration

    monkeypatch.setattr(streams, "_in_turn", looked_at)
    try:
        streams.streamed_components(spark, "/root/testdata/sf0.001")
    except StopIteration:
        pass
    assert len(plans) == 4 and not any("min_by" in p for p in plans)


def test_facts_cluster_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(dbscan, "assign_clusters", lambda rows: calls.append(1) or rows.withColumn("cluster_id", F.lit(-1).cast("bigint")))
    stats = "cluster_id bigint, district string, number_of_incidents bigint, cluster_radius_metres double, severity_score double, risk_level string"
    monkeypatch.setattr(scores.hotspots, "cluster_statistics", lambda rows: spark.createDataFrame([], stats))
    found = spark.createDataFrame([], "district string, risk_score double, risk_level string")
    monkeypatch.setattr(lookups.risk, "risk_scores", lambda *_: (found, None))
    monkeypatch.setattr(scores, "materialize", lambda df: df)
    monkeypatch.setattr(lookups, "materialize", lambda df: df)
    assert lookups.scoring_facts(spark, "/root/testdata/sf0.001").columns == ["fact", "value"]
    assert len(calls) == 1
