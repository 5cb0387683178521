"""Isolation-forest scores (Liu, Ting, Zhou 2008) with per-tree fits and batched scoring."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import require_all
from .features import SENSITIVE, feature_matrix
from .scale import exact_quantiles, materialize, scalar_of

# The tree functions travel to the executors by value; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 200
SAMPLE = 256

TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One random tree as flat arrays; leaves carry their expected depth."""
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}
    todo = [(np.arange(len(sample)), 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = at
        part = sample[rows]
        varied = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else np.array([], dtype=int)
        leaf = depth >= limit or len(varied) == 0
        feature = -1 if leaf else int(rng.choice(varied))
        cut = 0.0 if leaf else float(rng.uniform(part[:, feature].min(), part[:, feature].max()))
        nodes["feature"].append(feature)
        nodes["cut"].append(cut)
        nodes["left"].append(at)
        nodes["right"].append(at)
        nodes["depth"].append(depth + _average_path(len(rows)))
        if not leaf:
            low = part[:, feature] <= cut
            todo.append((rows[low], depth + 1, at, "left"))
            todo.append((rows[~low], depth + 1, at, "right"))
    return nodes


def fit_trees(matrix: DataFrame, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """One row per tree. Each tree sees its own sample of at most ``sample`` rows.

    Every row of the table may be drawn: a tree takes the rows that come first in its own hash order. Only rows below a
    bound on that hash, about four times the sample per tree, are copied to the tree before ranking, so what moves does not grow
    with the table. Samples depend only on ids and seed.
    """

    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / scalar_of(matrix, F.count(F.lit(1))))
    # A row meets all trees in one compiled loop; what the bound rejects is never copied.
    met = matrix.select("incident_id", "features", share.alias("_share"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    hashed = met.withColumn("h", F.xxhash64(F.lit(seed), F.col("tree"), F.col("incident_id")))
    drawn = hashed.where(F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(2**53)) <= F.col("_share")).drop("_share")
    first = F.row_number().over(Window.partitionBy("tree").orderBy("h", "incident_id"))
    samples = drawn.withColumn("r", first).where(F.col("r") <= sample).select("tree", "incident_id", "features")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("incident_id")
        data = np.array(ordered["features"].tolist(), dtype=float)
        tree = int(ordered["tree"].iloc[0])
        limit = max(1, math.ceil(math.log2(max(2, len(data)))))
        grown = _grow(data, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([{"tree": tree, **grown}])

    return samples.groupBy("tree").applyInPandas(fit, TREE_SCHEMA)


def _flat(tree: Row) -> tuple:
    """A tree as arrays to walk: feature, cut, the right and left child of each node in turn, depth, and its number of levels."""
    feature, left, right = (np.asarray(tree[name], dtype=np.int64) for name in ("feature", "left", "right"))
    level = np.zeros(len(feature), dtype=np.int64)
    for at in np.flatnonzero(feature >= 0):  # a parent comes before its children
        level[left[at]] = level[right[at]] = level[at] + 1
    return np.maximum(feature, 0), np.asarray(tree["cut"]), np.stack([right, left], axis=1).ravel(), np.asarray(tree["depth"]), int(level.max())


def score_rows(matrix: DataFrame, trees: DataFrame, sample_rows: int) -> DataFrame:
    """(incident_id, raw): minus the anomaly score of the forest, lower is more unusual.

    The model is collected once: ``TREES`` rows of at most 2 * SAMPLE nodes, whatever the table.
    Rows are walked a level at a time, a batch at once; a leaf leads to itself, so nothing is asked of rows that have arrived.
    """
    model = [_flat(row) for row in trees.orderBy("tree").collect()]
    shared = matrix.sparkSession.sparkContext.broadcast(model)
    norm = _average_path(sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                data = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
                rows = np.arange(n) * (len(data) // n)
                total = np.zeros(n)
                for feature, cut, child, depth, levels in shared.value:
                    at = np.zeros(n, dtype=np.int64)
                    for _ in range(levels):
                        at = child.take(2 * at + (data.take(rows + feature.take(at)) <= cut.take(at)))
                    total += depth.take(at)
                raw = -np.power(2.0, -(total / len(shared.value)) / norm)
                yield pa.RecordBatch.from_arrays([batch.column("incident_id"), pa.array(raw)], ["incident_id", "raw"])

    kept = matrix.select("incident_id", "features")
    schema = T.StructType([kept.schema["incident_id"], T.StructField("raw", T.DoubleType())])
    return kept.mapInArrow(score, schema)


def isolation_scores(
    df: DataFrame,
    contamination: float = 0.05,
    random_state: int = 42,
    feature_columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    exclude: Sequence[str] = SENSITIVE,
    trees: int = TREES,
) -> DataFrame:
    """(incident_id, anomaly_score, is_anomaly); lower is more unusual, below zero is flagged."""
    require_all([(0.0 < contamination <= 0.5, "contamination must be within (0, 0.5]")], "forest parameters")
    matrix = materialize(feature_matrix(df, feature_columns, keys, exclude))
    rows = matrix.count()
    if rows < 2:
        raise ValueError(f"at least 2 rows are needed, got {rows}")
    model = fit_trees(matrix, random_state, trees)
    scored = materialize(score_rows(matrix, model, min(SAMPLE, rows)))
    offset = exact_quantiles(scored, "raw", {"offset": contamination}).scalar()
    return scored.withColumn("anomaly_score", F.col("raw") - offset).select(
        "incident_id", "anomaly_score", (F.col("anomaly_score") < 0).alias("is_anomaly")
    )
