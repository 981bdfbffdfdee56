"""Planes and features as tables, against the kernels on one pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import rigid
from scanloom.operators import evaluation, registration, voxels
from scanloom.plans import fixtures, loops, queries
from scanloom.plans.store import cut


@pytest.fixture(scope="module")
def sides(spark, small):
    a, b, guess = queries._planes_and_guesses(spark, small)
    return cut(a), cut(b), cut(guess)


def clouds(spark, small, number):
    """Points of a scan and of its copy, by pt_idx."""
    table = fixtures.patches(spark, small)
    both = table.unionByName(fixtures.copies(table, fixtures.near_poses(spark, small)))
    return [both.where(F.col("scan_id") == s).orderBy("pt_idx").toPandas()[["x", "y", "z"]].to_numpy() for s in (number, number + fixtures.COPY)]


def square(pose):
    return np.vstack([np.reshape(pose, (3, 4)), [0, 0, 0, 1]])


def test_planes_equal_the_kernel(spark, small):
    found = voxels.planes(fixtures.patches(spark, small).where("scan_id = 3")).orderBy("vx", "vy", "vz").toPandas()
    want = rigid.planes(clouds(spark, small, 3)[0])
    got = found[["mx", "my", "mz", "nx", "ny", "nz"]].to_numpy()
    assert len(got) == len(want) > 20
    assert np.allclose(got[:, :3], want[:, :3]) and np.allclose(np.abs((got[:, 3:] * want[:, 3:]).sum(axis=1)), 1)


def test_pairs_and_poses_equal_the_kernel(spark, small, sides):
    a, b, guess = sides
    poses = {r.pair_id: r.pose for r in registration.plane_poses(a, b, guess).collect()}
    pairs = {r.pair_id: r["count"] for r in registration.plane_pairs(a, b, guess).groupBy("pair_id").count().collect()}
    guesses = {r.pair_id: r.pose for r in guess.collect()}
    for number in (0, 7):
        one, two = (rigid.planes(p) for p in clouds(spark, small, number))
        start = square(guesses[2 * number])
        assert pairs[2 * number] == len(rigid.plane_pairs(one, two, start)[0])
        assert np.allclose(poses[2 * number], rigid.plane_refine(one, two, start)[:3].ravel(), atol=1e-6)


def test_refinement_is_what_comes_close(spark, small, sides):
    """The guesses alone would fail the query."""
    a, b, guess = sides
    truth = fixtures.poses(spark, small).select((F.col("pair_id") * 2).alias("pair_id"), "truth")
    error = lambda poses: evaluation.pose_errors(truth.join(poses.select("pair_id", "pose"), "pair_id"))
    assert error(guess).where("rte < 0.1 or rre < 0.3").count() == 0
    assert error(registration.plane_poses(a, b, guess)).where("rte > 0.02 or rre > 0.1").count() == 0
    few = a.where("pair_id <> 4").unionByName(a.where("pair_id = 4").limit(4))
    kept = {r.pair_id: r.pose for r in registration.plane_poses(few, b, guess).collect()}
    assert len(kept) == guess.count() and kept[4] == [r.pose for r in guess.where("pair_id = 4").collect()][0]


def test_no_point_is_exchanged_for_a_pair(spark, small):
    table, pairs = queries._loop_tables(spark, small)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = loops.Features(table)
        posed = pairs.withColumn("pose", F.array(*[F.lit(x) for x in loops.IDENTITY]))
        joined = posed.select("pair_id", F.col("scan_a").alias("scan_id"), "pose").join(kept.background, "scan_id")
        plan = joined._jdf.queryExecution().sparkPlan().toString() and joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # of the pairs
        grids = loops.moved_grids(posed, kept)
        plan = grids._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and "partial_max_by" in plan  # of the pairs, and of cells
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scores_need_both_gates(spark, small):
    """A pose that is turned away fails the grids, whatever the nodes say."""
    table, pairs = queries._loop_tables(spark, small)
    kept = loops.Features(table)
    own = pairs.where("gt = 1")
    truth = fixtures.poses(spark, small, 50).select((F.col("pair_id") * 2).alias("pair_id"), "truth")
    right = own.join(truth, "pair_id").withColumnRenamed("truth", "pose")
    wrong = own.withColumn("pose", F.array(*[F.lit(x) for x in (-1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]))
    for posed, alike in ((right, True), (wrong, False)):
        same = loops.background.grid_similarity(loops.moved_grids(posed, kept), loops._side(posed, kept.grids, "scan_b"))
        assert {r.similarity > 0.7 for r in same.collect()} == {alike}
