import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.operators import scale


@pytest.fixture
def tiny_groups(monkeypatch):
    """Make the large-group path run on small data."""
    monkeypatch.setattr(scale, "SMALL_GROUP", 50)
    monkeypatch.setattr(scale, "SKETCH_ACCURACY", 100)
    monkeypatch.setattr(scale, "BRACKET", 4.0 / 100)


def _numbers(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=4000)] + [("flat", 7.0)] * 500 + [("few", 1.0), ("few", 4.0)]
    return spark.createDataFrame(rows, "g string, v double"), rows


@pytest.mark.parametrize("p", [0.0, 1 / 3, 0.5, 0.95, 1.0])
def test_quantiles_match_numpy(spark, tiny_groups, p):
    df, rows = _numbers(spark)
    got = {r["g"]: r["q"] for r in scale.exact_quantiles(df, "v", {"q": p}, ["g"]).collect()}
    for g in ("hot", "flat", "few"):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], p), abs=1e-12)


def test_quantiles_without_group_and_with_nulls(spark, tiny_groups):
    df, rows = _numbers(spark)
    with_nulls = df.unionByName(spark.createDataFrame([("x", None)], "g string, v double"))
    row = scale.exact_quantiles(with_nulls, "v", {"a": 0.25, "b": 0.75}).first()
    values = [v for _, v in rows]
    assert row["a"] == pytest.approx(np.quantile(values, 0.25)) and row["b"] == pytest.approx(np.quantile(values, 0.75))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_safe_join_equals_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, 1).when(F.col("id") % 2 == 0, F.col("id") % 50).alias("k"))
    right = spark.range(1, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = scale.skew_safe_join(left, right, ["k"], how, rows=100)
    want = left.join(right, ["k"], how)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_skew_safe_join_spreads_the_hot_key(spark):
    left = spark.range(2000).select("id", F.lit(1).alias("k"))
    hot = scale.hot_keys(left, ["k"], rows=100).collect()
    assert [(r["k"], r["_spread"]) for r in hot] == [(1, 21)]


def test_dense_index(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), F.when(F.col("id") % 3 == 0, "a").alias("g"))
    rows = scale.dense_index(df, ["x"], "n").collect()
    assert all(r["n"] == r["x"] for r in rows)
    for key in ("a", None):
        mine = sorted((r["x"], r["n"]) for r in scale.dense_index(df, ["x"], "n", ["g"]).collect() if r["g"] == key)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_modes_break_ties_low(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (1, "c"), (2, "z"), (2, None), (2, "y")], "g int, v string")
    got = {r["g"]: r["m"] for r in scale.value_modes(df, ["g"], {"v": "m"}).collect()}
    assert got == {1: "c", 2: "y"}


def test_materialize_keeps_rows_and_cuts_lineage(spark):
    df = spark.range(10).withColumn("y", F.col("id") * 2)
    kept = scale.materialize(df)
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_run_scope_removes_its_tables(spark):
    import os

    with scale.run_scope(spark):
        kept = scale.materialize(spark.range(5))
        paths = list(kept.inputFiles())
        assert kept.count() == 5 and all(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)
