"""Steps whose work must not outgrow the input: boxes, panels, words, buckets, edges, trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.operators import forest, graph, radius, similarity
from caseweave.sources.keyed import KeyedTable

R = 6_371_000.0


def brute(lat, lon, b_lat, b_lon, mult, radius_m):
    out = []
    for a, o in zip(np.radians(lat), np.radians(lon)):
        h = np.sin((np.radians(b_lat) - a) / 2) ** 2 + np.cos(a) * np.cos(np.radians(b_lat)) * np.sin((np.radians(b_lon) - o) / 2) ** 2
        out.append(mult[2 * R * np.arcsin(np.sqrt(np.clip(h, 0, 1))) <= radius_m].sum())
    return np.array(out)


@pytest.mark.parametrize("centre,spread,radius_m", [
    ((12.9, 77.6), 0.02, 1000.0), ((0.0, 0.0), 0.01, 500.0), ((-0.001, 179.999), 0.01, 800.0), ((78.0, 20.0), 0.03, 1000.0),
    ((89.99, 0.0), 0.01, 500.0), ((45.0, 10.0), 20.0, 2e6), ((10.0, 10.0), 1e-9, 1000.0),
])
def test_near_counts_against_brute_force(monkeypatch, centre, spread, radius_m):
    monkeypatch.setattr(radius, "COMPARED", 1000)
    rng = np.random.default_rng(3)
    draw = lambda n: (np.clip(rng.normal(centre[0], spread, n), -90, 90), rng.normal(centre[1], spread, n) % 360)
    (lat, lon), (b_lat, b_lon), mult = draw(120), draw(500), rng.integers(1, 5, 500)
    got = radius._near_counts(lat, lon, b_lat, b_lon, mult, radius_m, radius.radius_half_chord_sq(radius_m))
    assert (got == brute(lat, lon, b_lat, b_lon, mult, radius_m)).all()


@pytest.mark.parametrize("held", [500_000, 100])
def test_dense_cells_are_counted_without_being_split(spark, monkeypatch, held):
    def never(*_):
        raise AssertionError("split")

    monkeypatch.setattr(radius, "_split", never)
    monkeypatch.setattr(radius, "NEAR_COORDS", held)
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(12.0, 12.02, 1500), rng.uniform(77.0, 77.02, 1500)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))], "incident_id int, latitude double, longitude double")
    got = {(r["latitude"], r["longitude"]): r["neighbours"] for r in radius.neighbour_counts(df, 1000.0).collect()}
    want = brute(lat, lon, lat, lon, np.ones(1500, dtype=int), 1000.0) - 1
    assert got == {(a, b): n for a, b, n in zip(lat, lon, want)}


def texts(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, "T", " ".join(rng.choice(vocabulary, 12))) for i in range(90)] + [(90, "T", ""), (91, "T", None), (92, None, "lone words"), (93, "T", "a b")]
    return spark.createDataFrame(rows, "incident_id int, crime_type string, narrative string")


def test_weights_are_the_same_however_many_words_are_broadcast(spark, monkeypatch):
    df = texts(spark)
    read = lambda: sorted((r["block"], r["doc"], r["token"], round(r["weight"], 12)) for r in similarity.tfidf_weights(df).collect())
    monkeypatch.setattr(similarity, "COMMON_WORDS", 10**9)
    every = read()
    monkeypatch.setattr(similarity, "COMMON_WORDS", 60)
    assert read() == every
    lengths = {}
    for _, doc, _, w in every:
        lengths[doc] = lengths.get(doc, 0.0) + w * w
    assert len(lengths) == 90 and all(math.isclose(v, 1.0, abs_tol=1e-9) for v in lengths.values())


def test_panels_give_the_same_matches(spark, monkeypatch):
    df = texts(spark)
    read = lambda: sorted(tuple(r) for r in similarity.cosine_top_k(df, 0.2, 3).collect())
    one = read()
    monkeypatch.setattr(similarity, "TILE_ROWS", 8)
    monkeypatch.setattr(similarity, "PANELS", 3)
    assert one and read() == one


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    from glob import glob

    name, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "64k")
    try:
        table = KeyedTable(spark, str(tmp_path), "id bigint, n bigint", ["id"], lambda: [F.sum("n").alias("n")], buckets=1)
        table.append(spark.range(0, 300_000, 1, 8).select("id", F.xxhash64("id").alias("n")), 0)
    finally:
        spark.conf.set(name, before)
    assert len(glob(f"{tmp_path}/delta/batch=0/bucket=0/*.parquet")) > 1
    assert table.read().count() == 300_000


def test_edges_carry_no_text_twice(spark, capsys):
    df = spark.createDataFrame([(1, "T", "D", "2024-01-01", "p"), (None, "T", "D", "2024-01-01", "q")], "incident_id int, crime_type string, district string, occurrence_datetime string, offender_id string")
    edges = graph.graph_edges(df)
    assert {tuple(r) for r in edges.collect()} == {("1", "LOC::D", "occurred_at", 1), ("1", "p", "involved_in", 1), (None, "LOC::D", "occurred_at", 1), (None, "q", "involved_in", 1)}
    edges.explain()
    assert "min_by(struct(source" not in capsys.readouterr().out


def test_trees_draw_in_a_compiled_loop(spark, capsys):
    df = spark.range(600).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features")).withColumnRenamed("id", "incident_id")
    fitted = forest.fit_trees(df, trees=3)
    fitted.explain()
    assert "lambda" not in capsys.readouterr().out
    trees = fitted.collect()
    scored = {r["incident_id"]: r["raw"] for r in forest.score_rows(df, fitted, 256).collect()}

    def depth(tree, x):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["left"][at] if x[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
        return tree["depth"][at]

    for i in (0, 17, 599):
        want = -(2.0 ** -(sum(depth(t, [float(i), 1.0]) for t in trees) / 3 / forest._average_path(256)))
        assert scored[i] == pytest.approx(want, rel=1e-12)
