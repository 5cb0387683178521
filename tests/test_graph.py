import numpy as np
import pytest

from caseweave.operators import components, graph, linkage

SCHEMA = "incident_id string, crime_type string, district string, occurrence_datetime timestamp_ntz, police_station string, offender_id string, victim_id string"


def cases(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, "T", d, datetime(2024, 1, 2, 3, 4, 5), s, o, v) for i, d, s, o, v in rows], SCHEMA)


ROWS = [
    ("1", "D", "S", "p, q ,p", None),
    ("2", "D", None, None, "q"),
    ("3", "D", "S", "", "v"),
    ("4", "E", "S", "r", "r"),
]


def test_edges(spark):
    got = {(r["source"], r["target"]): (r["relation"], r["weight"]) for r in graph.graph_edges(cases(spark, ROWS)).collect()}
    assert got == {
        ("1", "LOC::D::S"): ("occurred_at", 1), ("2", "LOC::D"): ("occurred_at", 1), ("3", "LOC::D::S"): ("occurred_at", 1), ("4", "LOC::E::S"): ("occurred_at", 1),
        ("1", "p"): ("involved_in", 2), ("1", "q"): ("involved_in", 1), ("2", "q"): ("victim_of", 1), ("3", "v"): ("victim_of", 1),
        ("4", "r"): ("involved_in", 1),  # the offender link was written first
    }


def test_bridges_equal_columns(spark):
    """People given by bridge tables make the same graph as people in the incident's cells."""
    people = [("1", "p"), ("1", "q"), ("1", "p"), ("4", "r"), ("9", "stranger")]
    victims = [("2", "q"), ("3", "v"), ("4", "r"), ("4", None)]
    bare = cases(spark, [(i, d, s, None, None) for i, d, s, _, _ in ROWS])
    links = {
        "offender_links": spark.createDataFrame(people, "incident_id string, offender_id string"),
        "victim_links": spark.createDataFrame(victims, "incident_id string, victim_id string"),
    }
    for got, want in zip(graph.build_graph(bare, **links), graph.build_graph(cases(spark, ROWS))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_nodes_and_degrees(spark):
    ages = spark.createDataFrame([("q", 30), ("v", 40)], "id string, age int")
    nodes, edges = graph.build_graph(cases(spark, ROWS), ages, ages)
    rows = {r["id"]: r for r in nodes.collect()}
    assert (rows["q"]["type"], rows["q"]["label"], rows["q"]["age"], rows["q"]["degree"]) == ("offender", "Offender q", 30, 2)
    assert (rows["v"]["type"], rows["v"]["age"]) == ("victim", 40)
    assert rows["LOC::D"]["label"] == "D" and rows["LOC::D::S"]["label"] == "S, D"
    assert rows["1"]["occurrence_datetime"] == "2024-01-02T03:04:05"
    assert rows["LOC::D::S"]["degree_centrality"] == pytest.approx(round(2 / 10, 6))
    stats = graph.graph_statistics(nodes, edges).first()
    assert (stats["node_count"], stats["edge_count"], stats["connected_components"]) == (11, 9, 2)
    assert stats["density"] == pytest.approx(2 * 9 / (11 * 10))


def test_prune_removes_light_edges_and_lonely_nodes(spark):
    nodes, edges = graph.build_graph(cases(spark, ROWS), min_weight=2)
    assert sorted(r["id"] for r in nodes.collect()) == ["1", "p"] and edges.count() == 1


def test_hops(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]
    edges = spark.createDataFrame([(s, t, "r", 1) for s, t in pairs], "source string, target string, relation string, weight int")
    start = spark.createDataFrame([("a",)], "id string")
    visited, touched = graph.k_hop(edges, start, 2)
    assert {r["id"]: r["hop"] for r in visited.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert sorted((r["source"], r["target"]) for r in touched.collect()) == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize(
    "n,pairs",
    [
        (60, [(i, i + 1) for i in range(49)]),  # a path and lonely nodes
        (200, [(0, i) for i in range(1, 120)]),  # a hub
        (150, [tuple(map(int, p)) for p in np.random.default_rng(9).integers(0, 150, size=(90, 2))]),
        (3, []),
    ],
)
def test_components(spark, n, pairs):
    edges = spark.createDataFrame(pairs, "s bigint, t bigint")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in components.connected_components(edges, nodes, "s", "t", "node").collect()}
    assert got == union_find(n, pairs)


def test_pairs_of_large_incidents_are_complete(spark):
    rows = [("i", f"p{k:03d}") for k in range(200)] + [("j", "p000"), ("j", "p001"), ("k", "p000"), ("k", "p001"), ("k", "p001"), ("l", None)]
    bridge = spark.createDataFrame(rows, "incident_id string, offender_id string")
    got = {(r.person_a, r.person_b): r.incidents for r in linkage.co_offender_pairs(bridge).collect()}
    assert len(got) == 200 * 199 // 2 and got.pop(("p000", "p001")) == 3 and set(got.values()) == {1} and all(a < b for a, b in got)
    victims = bridge.where("offender_id < 'p100'").withColumnRenamed("offender_id", "victim_id")
    got = {(r.offender_id, r.victim_id): r.incidents for r in linkage.offender_victim_pairs(bridge, victims).collect()}
    assert len(got) == 200 * 100 and got["p000", "p001"] == 3 and got["p150", "p001"] == 1


def test_visibility_and_search(spark):
    nodes, edges = graph.build_graph(cases(spark, ROWS))
    shown, kept = graph.visible_nodes(nodes, edges, ["offender"])
    assert {r["type"] for r in shown.collect()} == {"offender"} and kept.count() == 9
    assert graph.visible_nodes(nodes, edges, ["incident", "offender"], True)[1].count() == 4  # both ends shown: 1-p, 1-q, 2-q, 4-r
    assert {r["id"] for r in graph.search_nodes(nodes, "OFFENDER").collect()} == {"p", "q", "r"}
    sub_nodes, own = graph.incident_subgraph(nodes, edges, "1")
    assert own.count() == 3 and sub_nodes.count() == 4
