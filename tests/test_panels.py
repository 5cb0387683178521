"""Matching by stored panels: the same matches however rows are dealt, and few bytes of intermediate tables."""

from __future__ import annotations

import os

import numpy as np
import pytest

from caseweave.operators import scale, similarity
from test_texts import brute, close


def documents(n, words, seed=3):
    """(id, block, text) with copies, blank texts, an accent, blocks of different sizes and one row alone."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"{'é' if i % 7 == 0 else 'w'}{i}" for i in range(words)])
    share = 1.0 / np.arange(1, words + 1)
    docs = [(f"{i:05d}", "ab cde"[int(rng.integers(0, 6)) if i % 3 else 0], " ".join(rng.choice(vocabulary, int(rng.integers(1, 40)), p=share / share.sum()))) for i in range(n)]
    copies = [(f"c{i:04d}", b, " ".join(reversed(t.split()))) for i, (_, b, t) in enumerate(docs[: n // 3])]
    return [*docs, *copies, *[(f"h{i:04d}", "a", "w1 w2 w2") for i in range(n // 2)], ("e1", "a", ""), ("e2", "a", "?"), ("s1", "alone", "w1 w2")]


@pytest.mark.parametrize("share,outer,panel", [(0.05, 100, 100_000), (2.0, 0, 2_000), (2.0, 10**9, 9_000), (0.0, 100, 2_000)])
def test_panels_and_kinds_of_words_give_the_matches_of_brute_force(spark, monkeypatch, share, outer, panel):
    for name, value in {"DENSE_SHARE": share, "OUTER_CELLS": outer, "LEAST_PANEL": panel, "TILE_ROWS": 16, "SCANNED": 32, "CODED_TERMS": 500, "PANELS": 1000}.items():
        monkeypatch.setattr(similarity, name, value, raising=False)
    docs = documents(150, 80)
    df = spark.createDataFrame(docs, "incident_id string, crime_type string, mo_text string").repartition(5)
    got = {(r[0], r[1]): r[2] for r in similarity.cosine_top_k(df, 0.3, 4).collect()}
    close(got, brute(docs, 0.3, 4))


def test_equal_scores_go_to_the_lowest_id_across_panels(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LEAST_PANEL", 1_000, raising=False)
    monkeypatch.setattr(similarity, "PANELS", 1000)
    docs = [(f"{i:03d}", "a", f"same word{i}") for i in range(80)] + [("900", "a", "same"), ("901", "a", "other")]
    close(run := {(r[0], r[1]): r[2] for r in similarity.cosine_top_k(spark.createDataFrame(docs, "incident_id string, crime_type string, mo_text string"), 0.01, 3).collect()}, brute(docs, 0.01, 3))
    assert {b for a, b in run if a == "050"} == {"900", "000", "001"}


def test_intermediate_tables_stay_near_the_size_of_the_texts(spark):
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"word{i}" for i in range(4000)])
    docs = [(i, "a", " ".join(rng.choice(vocabulary, 250))) for i in range(800)]
    df = scale.materialize(spark.createDataFrame(docs, "incident_id int, crime_type string, mo_text string"))
    size = lambda paths: sum(os.path.getsize(os.path.join(d, f)) for p in paths for d, _, names in os.walk(p.removeprefix("file:")) for f in names if f.endswith(".parquet"))
    given, before = size(scale._written[-1:]), len(scale._written)
    similarity.cosine_top_k(df, 0.9).collect()
    assert 0 < size(scale._written[before:]) < 2.5 * given


def test_groups_hold_each_pair_once():
    pairs = [(i, j) for i in range(20) for j in range(i, 20)]
    for tasks in (1, 4, 1000):
        groups = similarity._grouped(pairs, tasks)
        assert sorted(p for g in groups for p in g) == pairs and len(groups) >= min(tasks, len(pairs))
        assert all(len({x for p in g for x in p}) <= 2 * similarity.PANEL_GROUP for g in groups)
