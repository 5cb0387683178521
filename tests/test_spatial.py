import math

import numpy as np
import pytest

from caseweave.operators import cleaning, dbscan, hotspots, radius

R = 6_371_000.0


def metres(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def brute_dbscan(points, eps, need):
    """Reference labels: components of core points by first core row; border takes the lowest."""
    n = len(points)
    near = [[j for j in range(n) if metres(points[i], points[j]) <= eps] for i in range(n)]
    core = [len(x) >= need for x in near]
    label = [-1] * n
    nxt = 0
    for i in range(n):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], nxt
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = nxt
                        todo.append(j)
            nxt += 1
    for i in range(n):
        if not core[i]:
            reach = [label[j] for j in near[i] if core[j]]
            label[i] = min(reach) if reach else -1
    return label


def frame(spark, points):
    rows = [(i, "Theft", "D", float(a), float(b), "2024-01-01 00:00:00") for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "incident_id int, crime_type string, district string, latitude double, longitude double, occurrence_datetime string")


def labels(spark, points, eps, need):
    rows = dbscan.assign_clusters(frame(spark, points), eps, need).select("incident_id", "cluster_id").collect()
    return [c for _, c in sorted((r["incident_id"], r["cluster_id"]) for r in rows)]


def cloud(seed, centre, n, spread):
    rng = np.random.default_rng(seed)
    return [(float(a), float(b)) for a, b in rng.normal(centre, spread, size=(n, 2))]


def test_clean(spark):
    rows = [
        (1, "90", "180", "2024-01-01"), (2, "-90", "-180", "2024-01-01"), (3, "90.1", "0", "2024-01-01"), (4, "x", "0", "2024-01-01"),
        (5, None, "0", "2024-01-01"), (6, "0", "181", "2024-01-01"), (7, "0", "0", "soon"), (None, "0", "0", "2024-01-01"), (8, "NaN", "0", "2024-01-01"),
    ]
    df = spark.createDataFrame([(i, "T", "D", a, b, t) for i, a, b, t in rows], "incident_id int, crime_type string, district string, latitude string, longitude string, occurrence_datetime string")
    assert sorted(r["incident_id"] for r in cleaning.clean_coordinates(df).collect()) == [1, 2]


@pytest.mark.parametrize(
    "points,eps,need",
    [
        (cloud(1, (12.9, 77.6), 150, 0.004), 300.0, 6),
        (cloud(2, (0.0, 0.0), 150, 0.003), 250.0, 5),  # both hemispheres
        (cloud(3, (78.0, 20.0), 150, 0.01), 500.0, 4),  # far north, narrow cells
        ([(a, ((b + 180 + 180) % 360) - 180) for a, b in cloud(4, (10.0, 0.0), 150, 0.004)], 300.0, 5),  # around the 180th meridian
        ([(89.9999, float(x)) for x in range(-180, 180, 30)] + [(89.9, 0.0)], 100.0, 3),  # around the pole
    ],
)
def test_dbscan_against_brute_force(spark, points, eps, need):
    assert labels(spark, points, eps, need) == brute_dbscan(points, eps, need)


@pytest.mark.parametrize("direct", [1, 4, 64])
def test_refinement_gives_the_same_answer(spark, monkeypatch, direct):
    """A low limit forces box pairs to be split, as a cell with millions of points would."""
    monkeypatch.setattr(radius, "DIRECT_PAIRS", direct)
    points = cloud(5, (12.9, 77.6), 120, 0.0015) + cloud(6, (12.905, 77.606), 60, 0.0008) + [(12.9, 77.6)] * 30
    assert labels(spark, points, 300.0, 40) == brute_dbscan(points, 300.0, 40)
    got = {(r["latitude"], r["longitude"]): r["neighbours"] for r in radius.neighbour_counts(frame(spark, points), 200.0).collect()}
    assert got == {p: sum(metres(p, q) <= 200.0 for q in points) - 1 for p in set(points)}


def test_equal_coordinates_are_one_point(spark):
    points = [(1.0, 1.0)] * 500 + [(2.0, 2.0)] * 3
    assert labels(spark, points, 300.0, 10) == [0] * 500 + [-1] * 3
    assert labels(spark, points, 300.0, 3) == [0] * 500 + [1] * 3


def test_border_between_two_clusters_takes_the_lower(spark):
    step = 250.0 / (R * math.pi / 180)
    left, right = [(0.0, 0.0)] * 5, [(2 * step, 0.0)] * 5
    points = right[:1] + left + [(step, 0.0)] + right[1:]  # the middle point touches both, but is not core
    assert labels(spark, points, 300.0, 12) == brute_dbscan(points, 300.0, 12)
    assert labels(spark, points, 260.0, 5) == brute_dbscan(points, 260.0, 5)


def test_parameters(spark):
    with pytest.raises(ValueError, match="eps_meters.*min_samples"):
        dbscan.check_parameters(0, 1)


def test_statistics_of_one_spot(spark):
    clustered = dbscan.assign_clusters(frame(spark, [(1.0, 1.0)] * 12), 300.0, 10)
    row = hotspots.cluster_statistics(clustered).first()
    assert (row["number_of_incidents"], row["cluster_radius_metres"], row["density"], row["severity_score"]) == (12, 0.0, None, 12.0)


@pytest.mark.parametrize("scores,want", [([5, 5, 5], ["Medium"] * 3), ([1, 2, 3, 4], ["Low", "Medium", "High", "High"])])
def test_tiers(spark, scores, want):
    low, high = np.quantile(scores, 1 / 3), np.quantile(scores, 2 / 3)
    if len(set(scores)) > 1:
        want = ["High" if s >= high else "Medium" if s >= low else "Low" for s in scores]
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "cluster_id int, severity_score double")
    assert [r["risk_level"] for r in hotspots.relative_tiers(df).orderBy("cluster_id").collect()] == want


def test_grid_cells(spark):
    rows = [(i, "T", "D", s, 12.001 + 0.0001 * i, 77.0) for i, s in enumerate(["S1", "S1", "S1", "S2", "S2", None, None, None])]
    df = spark.createDataFrame(rows, "incident_id int, crime_type string, district string, police_station string, latitude double, longitude double")
    got = {r["police_station"]: (r["incident_count"], r["latitude"], r["risk_score"]) for r in hotspots.grid_hotspots(df).collect()}
    assert got == {"S1": (3, 12.001, 0.7), "STATION": (3, 12.0015, 0.7)}
    assert hotspots.grid_members(df).count() == 6
