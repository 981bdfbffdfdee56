"""The nearest of vectors seen block by block, and how often a vector is copied for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions.nearest import Nearest
from scanloom.operators import metric_index, retrieval


def brute(vectors, ids, k, exclusion):
    out = []
    for v, i in zip(vectors, ids.tolist(), strict=True):
        d2 = np.round(((vectors - v) ** 2).sum(axis=1), 6)
        seen = sorted((d, c) for d, c in zip(d2.tolist(), ids.tolist(), strict=True) if c < i - exclusion)
        out += [(i, c, d) for d, c in seen[:k]]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 1e-4, 0.0])
def test_equals_brute_force_with_ties(spread):
    """Near ties that rounding makes equal, and copies, go to the smaller id in any order of blocks."""
    dice = np.random.default_rng(3)
    vectors, ids = np.repeat(dice.normal(size=(60, 5)), 5, axis=0) + dice.normal(size=(300, 5)) * spread, np.arange(300) * 7
    for order in (range(0, 300, 20), reversed(range(0, 300, 20))):
        some = Nearest(vectors, ids, 6, 30)
        for at in order:
            some.see(np.arange(300), vectors[at : at + 20], ids[at : at + 20])
        query, cand, d2 = some.found()
        assert sorted(zip(query.tolist(), cand.tolist(), d2.tolist(), strict=True)) == brute(vectors, ids, 6, 30)


def scans(spark, n, size=8, step=1):
    dice = np.random.default_rng(5)
    return spark.createDataFrame([(i * step, dice.normal(size=size).tolist()) for i in range(n)], "id bigint, vec array<double>")


def rows(df):
    return sorted((r.query_id, r.rk, r.cand_id, r.d2) for r in df.collect())


def test_copies_do_not_grow_with_the_table(spark, monkeypatch):
    """Ten times the scans: not more blocks, so the same copies of each."""
    assert [retrieval.block_count(n, 64) for n in (10_000, 60_000)] == [16, 16]
    assert retrieval.block_count(10_000_000, 64) == 153  # a block's size is bounded
    ends = retrieval.block_ends(scans(spark, 2000), 100)
    assert len(ends) == 15 and max(np.diff([0, *ends])) < 160


def test_ids_far_apart(spark):
    """Blocks are of equal numbers of scans, not of equal ranges of ids."""
    near, far = (retrieval.candidates(scans(spark, 300, step=s), 5, 10 * s, block=32) for s in (1, 10**9))
    assert rows(far) == [(q * 10**9, rk, c * 10**9, d) for q, rk, c, d in rows(near)]


def test_undefined_vectors_have_no_candidates(spark):
    odd = spark.createDataFrame([(60, [float("nan")] * 8), (61, None), (62, [float("inf")] * 8)], "id bigint, vec array<double>")
    table = scans(spark, 150).where("id not between 60 and 62")
    both = table.unionByName(odd)
    want = rows(retrieval.candidates(table, 5, 10))
    assert rows(retrieval.candidates(both, 5, 10)) == want
    assert rows(metric_index.search(metric_index.build(both, 8), both, 5, 10)) == want
    padded = retrieval.padded(retrieval.candidates(both, 5, 10), both, 5, 10)
    assert padded.count() == 5 * 139 and padded.where(F.col("query_id").between(60, 62) & (F.col("cand_id") == -1)).count() == 15


def test_a_query_goes_to_groups_not_to_parts(spark, monkeypatch):
    """Vectors without clusters: many parts may hold a candidate, few groups take the query."""
    monkeypatch.setattr(metric_index, "PART", 8)
    table = scans(spark, 600)
    index = metric_index.build(table, 4)
    made = []
    asked = metric_index._asked
    monkeypatch.setattr(metric_index, "_asked", lambda *a: made.append(asked(*a)) or made[-1])
    assert rows(metric_index.search(index, table, 5, 10)) == rows(retrieval.candidates(table, 5, 10))
    assert len(index.parts) > 70 and made[1].groupBy("id").count().agg(F.max("count")).first()[0] <= retrieval.BLOCKS
