"""Components kept by batches against components found at once."""

import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators.components import connected_components
from caseweave.streaming.groups import Groups, run_components


def twin(spark, links, nodes=()):
    edges = spark.createDataFrame(links or [], "source string, target string")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).union(spark.createDataFrame([(n,) for n in nodes], "node string"))
    return {r.node: r.component for r in connected_components(edges, ends, "source", "target", "node").collect()}


def current(groups):
    rows = groups.current().collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def written(groups, batch):
    found = [groups.roots.spark.read.parquet(f"{t.folder}/delta/batch={batch}").count() if t.files.names(f"{t.folder}/delta/batch={batch}/bucket=*") else 0 for t in groups.tables()]
    return dict(zip(("labels", "roots", "named"), found))


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_pass(spark, tmp_path, seed):
    dice = random.Random(seed)
    groups, links, loose = Groups(spark, str(tmp_path), buckets=3), [], []
    for batch in range(10):
        new = [(f"n{dice.randrange(60):02d}", f"n{dice.randrange(60):02d}") for _ in range(4)] + [(f"m{batch}", f"m{batch}")]
        alone = [f"z{batch}", f"n{dice.randrange(60):02d}"]
        frame = spark.createDataFrame([*new, new[0], (None, "n01")], "source string, target string")
        groups.add(frame, batch, nodes=spark.createDataFrame([(n,) for n in alone], "node string"))
        if batch == 5:  # the batch is replayed
            groups.add(frame, batch, nodes=spark.createDataFrame([(n,) for n in alone], "node string"))
        links, loose = links + new, loose + alone
        if batch % 3 == 0 or batch == 9:
            assert current(groups) == twin(spark, links, loose)
    assert groups.labels.manifest()["through"] == 7  # compacted on the way


def test_only_changed_components_are_written(spark, tmp_path):
    groups = Groups(spark, str(tmp_path), buckets=3)
    chains = [(f"c{c:03d}", f"c{c:03d}-{n}") for c in range(100) for n in range(30)]
    groups.add(spark.createDataFrame(chains, "source string, target string"), 0)
    groups.add(spark.createDataFrame([("c001-5", "new"), ("c050-1", "c051-2")], "source string, target string"), 1)
    assert written(groups, 1)["labels"] == 1
    assert written(groups, 1)["roots"] <= 2 and written(groups, 1)["named"] <= 2
    got = current(groups)
    assert got["c051-7"] == "c050" and got["new"] == "c001" and got["c052-1"] == "c052"
    groups.add(spark.createDataFrame([], "source string, target string"), 2)
    assert current(groups) == got


def test_stream_with_restart(spark, tmp_path):
    for n in range(3):
        links = [(f"a{i}", f"a{i + 1}") for i in range(n * 4, n * 4 + 4)]
        spark.createDataFrame(links[::-1], "source string, target string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("source string, target string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run_components(stream, f"{tmp_path}/t", f"{tmp_path}/cp", buckets=2)  # goes on where it stopped
    assert set(current(Groups(spark, f"{tmp_path}/t", buckets=2)).values()) == {"a0"}
