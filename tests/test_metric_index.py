"""Search through pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import metric_index, retrieval


def vectors(spark, n, clusters, size=12, seed=1, spread=0.02):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(clusters, size))
    rows = [(i, (centres[dice.integers(clusters)] + dice.normal(size=size) * spread).tolist()) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(20)]  # copies, as ties
    return spark.createDataFrame(rows, "id bigint, vec array<double>")


def rows(df):
    return sorted((r.query_id, r.rk, r.cand_id, r.d2) for r in df.collect())


@pytest.mark.parametrize("clusters", [1, 40])
def test_equals_all_pairs(spark, monkeypatch, clusters):
    monkeypatch.setattr(metric_index, "PART", 32)
    scans = vectors(spark, 600, clusters)
    found = metric_index.search(metric_index.build(scans, 10), scans, 7, 20)
    assert rows(found) == rows(retrieval.candidates(scans, 7, 20))


def test_few_pairs_are_compared_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "PART", 64)
    scans = vectors(spark, 2000, 50)
    count = spark.sparkContext.accumulator(0)
    found = rows(metric_index.search(metric_index.build(scans, 64), scans, 5, 100, count))
    assert found == rows(retrieval.candidates(scans, 5, 100))
    assert count.value < 2020 * 2020 / 2 / 4


def test_added_vectors(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "PART", 32)
    scans = vectors(spark, 300, 5)
    index = metric_index.build(scans.where("id < 150"), 8)
    for low, high in ((150, 240), (240, 320)):
        new = scans.where((F.col("id") >= low) & (F.col("id") < high))
        index = metric_index.add(index, new)
        want = [r for r in rows(retrieval.candidates(scans.where(F.col("id") < high), 5, 30)) if r[0] >= low]
        assert rows(metric_index.search(index, new, 5, 30)) == want


def test_no_vectors(spark):
    none = vectors(spark, 20, 1).limit(0)
    assert metric_index.search(metric_index.build(none), none).collect() == []
    assert metric_index.add(metric_index.build(none), vectors(spark, 20, 1)).members.count() == 40
