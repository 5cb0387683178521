"""Training of the tier model: encoders once per fold, rows over all tasks, the whole grid."""

from __future__ import annotations

import math
import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier

from caseweave.operators import risk_model

SCHEMA = (
    "incident_id long, station_ratio double, category string, spatial_density_1km double, prior_offender double, "
    "property_loss double, time_bucket string, target double, label string"
)


def raw_rows(spark, n=600):
    rows = [
        (i, math.log(1 + i % 7), "ABC"[i % 3] if i % 11 else None, float(i % 13), float(i % 2), float(i % 100),
         risk_model.BUCKETS[i % 4], float(i % 3 == 0), "HIGH" if i % 100 > 60 else "LOW")
        for i in range(n)
    ]
    return spark.createDataFrame([*rows, (None, 0.0, "A", 1.0, 0.0, 1.0, "Night", 0.0, "LOW")], SCHEMA)


@pytest.fixture
def fits(monkeypatch):
    """(kind, parameter, rows, partitions) of each fit."""
    seen, lock = [], threading.Lock()

    def watch(kind, parameter):
        fit = kind._fit

        def watched(self, dataset):
            with lock:
                seen.append((kind.__name__, parameter(self), dataset.count(), dataset.rdd.getNumPartitions()))
            return fit(self, dataset)

        monkeypatch.setattr(kind, "_fit", watched)

    watch(Pipeline, lambda x: len(x.getStages()))
    watch(RandomForestClassifier, lambda x: x.getMaxDepth())
    return seen


def test_each_fold_is_encoded_once_and_dealt_over_tasks(spark, monkeypatch, fits):
    monkeypatch.setattr(risk_model, "LEAST_TASK_ROWS", 100, raising=False)
    rows = raw_rows(spark)
    model, metrics = risk_model.train_tier_model(rows, folds=3, trees=5)
    values = {r["metric"]: r["value"] for r in metrics.collect()}
    assert values["train_rows"] + values["held_out_rows"] == 600 and values["auc"] > 0.95 and values["validation_f1"] > 0.9 and values["f1"] > 0.9

    forests = [x for x in fits if x[0] == "RandomForestClassifier"]
    learnt = int(values["train_rows"])
    assert sorted(x[1] for x in forests)[:3] == [4, 4, 4] and len(forests) == 7
    # Each fold trains on what the others hold, for either depth; the last forest trains on all.
    for depth in (4, 8):
        some = [x[2] for x in forests if x[1] == depth and x[2] < learnt]
        assert len(some) == 3 and sum(some) == 2 * learnt
    assert [x[2] for x in forests if x[2] == learnt] == [learnt]
    assert sum(x[0] == "Pipeline" for x in fits) == 4
    assert min(x[3] for x in forests) > 1

    placed = model.transform(rows.where("incident_id is not null"))
    assert len(model.stages) == 9 and placed.where("prediction is not null").count() == 600


def test_tasks_grow_with_the_rows():
    assert risk_model._tasks(0, 8) == 1
    assert risk_model._tasks(12_000, 8) == 3
    assert risk_model._tasks(1_000_000, 8) == 8
    assert risk_model._tasks(10_000_000, 8) == 40
