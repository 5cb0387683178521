import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.operators import features, forest, risk
from caseweave.operators.checks import InputError


def test_feature_rules(spark):
    rows = [(i, None, 5.0, f"v{i}", i % 2 == 0, "a" if i % 3 else None, float(i) if i else None, "f") for i in range(60)]
    df = spark.createDataFrame(rows, "incident_id int, empty double, constant double, many string, flag boolean, level string, amount double, victim_gender string")
    m = features.feature_matrix(df)
    names = features.feature_names(m)
    assert names == ["flag", "amount", "level_a", "level_missing"]  # the gender column is excluded by default
    data = np.array([r["features"] for r in m.orderBy(F.col("incident_id").cast("int")).collect()])
    amount = np.array([np.median(range(1, 60)), *range(1, 60)])
    assert np.allclose(data[:, 1], (amount - amount.mean()) / amount.std())
    assert np.allclose(data[:, 0].mean(), 0) and set(data[:, 3]) == {0.0, 1.0}
    with pytest.raises(InputError):
        features.feature_matrix(df, ["constant", "empty"])
    with pytest.raises(InputError):
        features.feature_matrix(df, ["absent"])


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    rows = [(f"n{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    rows += [(f"out{i}", 9.0 + i, -9.0 - i) for i in range(6)]
    return spark.createDataFrame(rows, "incident_id string, a double, b double")


def test_forest_finds_planted_outliers(spark, cloud):
    scored = {r["incident_id"]: (r["anomaly_score"], r["is_anomaly"]) for r in forest.isolation_scores(cloud, trees=100).collect()}
    lowest = sorted(scored, key=lambda k: scored[k][0])[:15]
    assert {f"out{i}" for i in range(6)} <= set(lowest)
    assert abs(sum(flag for _, flag in scored.values()) - 0.05 * 306) <= 1
    again = {r["incident_id"]: r["anomaly_score"] for r in forest.isolation_scores(cloud.repartition(7), trees=100).collect()}
    assert all(again[k] == pytest.approx(scored[k][0], abs=1e-12) for k in scored)


def test_forest_guards(spark, cloud):
    with pytest.raises(ValueError, match="contamination"):
        forest.isolation_scores(cloud, contamination=0.6)


def risk_tables(spark):
    inc = spark.createDataFrame([(1, "A", "x", "true", 10.0), (2, "A", "x", "0", 0.0), (3, "B", "y", "True", None)], "incident_id int, district string, crime_type string, repeat_offender string, population_density double")
    clusters = spark.createDataFrame([(0, "A", 8.0, None, 10.0, 4)], "cluster_id int, district string, severity_score double, density double, cluster_radius_metres double, number_of_incidents int")
    trends = spark.createDataFrame([("A", "x", 10, "Stable"), ("A", "y", 2, "Increasing"), ("B", "x", 4, "Stable"), ("C", "x", 0, "Stable")], "district string, crime_type string, total_incidents int, trend_direction string")
    found = spark.createDataFrame([("A", "x", -4.0, "High"), ("A", "x", 3.0, "Moderate")], "district string, crime_type string, z_score double, severity string")
    return inc, clusters, trends, found


def test_risk_features(spark):
    rows = {r["district"]: r for r in risk.district_features(*risk_tables(spark)).collect()}
    a, c = rows["A"], rows["C"]
    assert (a["total_incidents"], a["crime_diversity"], a["average_z_score"], a["trend_anomalies"]) == (12, 2, 3.5, 2)
    assert (a["repeat_offender_percentage"], a["crime_rate"], a["average_hotspot_density"]) == (50.0, 12 / 5, 0.0)
    assert a["dominant_trend_direction"] == "Increasing"  # a tie goes to the lower word
    assert a["hotspot_coverage_ratio"] == pytest.approx(4 / 12)
    assert (c["total_incidents"], c["crime_rate"], c["hotspot_coverage_ratio"]) == (0, 0, 0)


def test_risk_scores_drop_missing_features(spark):
    scores, weights = risk.risk_scores(*risk_tables(spark))
    w = {r["feature"]: (r["weight"], r["normalized_weight"]) for r in weights.collect()}
    assert w["average_trend_strength"] == (0.1, 0.0) and sum(n for _, n in w.values()) == pytest.approx(1.0, abs=1e-3)
    rows = {r["district"]: r for r in scores.collect()}
    assert rows["A"]["average_hotspot_density_normalized"] == 0.5  # constant
    assert all(0 <= r["risk_score"] <= 100 for r in rows.values())
    scores, _ = risk.risk_scores(*risk_tables(spark), weights={"total_incidents": 2.0})
    got = {r["district"]: (r["risk_score"], r["risk_level"]) for r in scores.collect()}
    assert got == {"A": (100.0, "Critical"), "B": (33.33, "Moderate"), "C": (0.0, "Low")}


def test_risk_accepts_empty_but_not_missing(spark):
    inc, clusters, trends, found = risk_tables(spark)
    scores, _ = risk.risk_scores(inc, clusters.limit(0), trends, found.limit(0))
    assert scores.count() == 3
    with pytest.raises(InputError):
        risk.risk_scores(inc, clusters.drop("density"), trends, found)
    with pytest.raises(InputError):
        risk.risk_scores(inc, clusters, trends.limit(0), found)


@pytest.mark.parametrize("weights", [{"luck": 1.0}, {"total_incidents": -1.0}, {"total_incidents": 0.0}])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        risk.check_weights(weights)


def test_bad_thresholds_and_bands(spark):
    with pytest.raises(ValueError):
        risk.check_thresholds(50, 25, 75)
    df = spark.createDataFrame([(25.0,), (25.01,), (75.0,), (75.01,)], "risk_score double")
    from caseweave.functions.labels import dashboard_band, risk_band

    assert [r[0] for r in df.select(risk_band(F.col("risk_score"))).collect()] == ["Low", "Moderate", "High", "Critical"]
    assert [r[0] for r in df.select(dashboard_band(F.col("risk_score"))).collect()] == ["low", "low", "high", "critical"]


def test_dropped_columns_are_listed(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("many"), F.lit("x").alias("same"), (F.col("id") % 7).alias("number"), F.lit(None).cast("double").alias("empty"))
    names = ["many", "same", "number", "empty"]
    assert {tuple(r) for r in features.dropped_columns(df, names).collect()} == {("many", "more than 50 levels"), ("same", "empty or constant"), ("empty", "empty or constant")}
    wide = df.withColumn("incident_id", F.col("many"))
    assert len(features.feature_names(features.feature_matrix(wide, names, max_levels=300))) == 201
