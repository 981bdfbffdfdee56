"""Operator 13 against all pairs of vectors in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import embedding_dedup as ed


def brute(ids, vectors, threshold=0.9):
    """(id, n_links, component_id, kept) of each row."""
    n, size = len(vectors), max((len(v) for v in vectors if v), default=0)
    good = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    x = np.zeros((n, size))
    for i, v in enumerate(vectors):
        if good[i]:
            x[i, : len(v)] = np.array(v, dtype=float) / max(map(abs, v))
    norm = np.sqrt((x * x).sum(axis=1))
    norm[norm == 0] = 1
    link = (x @ x.T / np.outer(norm, norm)) >= threshold
    link[[i for i in range(n) if not good[i]]] = False
    np.fill_diagonal(link, False)
    label, out = list(range(n)), []
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == label:
            break
        label = new
    for i in range(n):
        least = min((ids[j] for j in range(n) if label[j] == label[i] and ids[j] is not None), default=None)
        out.append((ids[i], int(link[i].sum()), least, ids[i] == least))
    return sorted(out, key=str)


def run(df, **more):
    return sorted(map(tuple, ed.near_vectors(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 32)
    monkeypatch.setattr(ed, "TILE", 8)
    monkeypatch.setattr(ed, "PAIRS", 16)


@pytest.mark.parametrize("size", [3, 16, 40, 70])
def test_classes(spark, small_blocks, size):
    dice = np.random.default_rng(size)
    vectors = list(dice.normal(size=(60, size)) * 3)
    for v in vectors[:12]:  # chains, clusters and copies
        vectors += [v + dice.normal(size=size) * 0.35 * dice.random() for _ in range(8)]
    vectors += [vectors[0]] * 9 + [vectors[1] * 2.0] * 2
    vectors = [list(map(float, v)) for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    assert run(df) == brute(list(range(len(vectors))), vectors)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.1], [1.0, 0.1, 0.0], [1e300, 1e299], [1e-300, 1e-301], [0.0, 1.0], [-0.0, 1.0], None, [1.0, 0.1]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, None, None, None, 6]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "`id.x` bigint, `v.x` array<double>")
    df = df.withColumns({"v": F.lit(1), "pos": F.lit("x"), "vec_id": F.lit(0), "c": F.lit(0), "block": F.lit(0)})
    assert run(df, id_col="id.x", vector_col="v.x") == brute(ids, vectors)
    assert run(df.limit(0), id_col="id.x", vector_col="v.x") == []
    assert run(df.where("`v.x` is null"), id_col="id.x", vector_col="v.x") == [(0, 0, 0, True), (None, 0, None, True)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    found = sorted(map(tuple, ed.op13_embedding_tiles(spark, f"/root/testdata/{sf}").collect()), key=str)
    assert found == brute([r.vec_id for r in rows], [r.embedding for r in rows])


def test_far_blocks_are_not_compared(spark):
    around = [[float(np.cos(a)), float(np.sin(a))] for a in np.linspace(0, 3, 400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(around)], "pos bigint, v array<double>")
    placed = ed._along(df, np.array([1.0, 0.0])).withColumn("block", F.floor((399 - F.col("pos")) / 20))
    pairs = {tuple(r) for r in ed.block_pairs(placed, 0.9).collect()}
    assert all((i, i) in pairs for i in range(20)) and (0, 19) not in pairs
    assert len(pairs) < 100  # of 210
