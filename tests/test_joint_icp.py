"""ICP in rounds over all pairs, against the kernel on one pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import rigid
from scanloom.operators import joint_icp, registration
from scanloom.plans import queries
from scanloom.plans.store import by_scan, cut

SCHEMA = "pair_id bigint, label int, pt_idx bigint, x double, y double, z double, pose string"
STILL = [float(i in (0, 5, 10)) for i in range(12)]


@pytest.fixture(scope="module")
def sides(spark, small):
    a, b, guess = queries._near_guess(spark, small)
    columns = ["pair_id", "label", "pt_idx", "x", "y", "z"]
    return cut(a.select(*columns)), cut(b.select(*columns)), cut(guess)


def test_poses_equal_the_kernel(sides):
    a, b, guess = sides
    want = {r.pair_id: r.pose for r in registration.icp_poses(a, b, guess).collect()}
    got = {r.pair_id: r for r in joint_icp.icp_rounds(a, b, guess).collect()}
    assert got.keys() == want.keys() and len(got) >= 20
    assert all(np.allclose(got[k].pose, want[k], atol=1e-9) and got[k].converged and got[k].rounds > 1 for k in want)
    start = {r.pair_id: r.pose for r in guess.collect()}
    assert all(np.abs(np.subtract(start[k], want[k])).max() > 0.05 for k in want)


def rows(pair, points, offset=0.0):
    return [(pair, 50, i, *(float(v) + offset for v in p), "x") for i, p in enumerate(points)]


def test_odd_pairs(spark):
    """Turned and shifted clouds over several voxels and both sides of zero, repeated and
    broken points, pairs of few points, of no points, without a guess and with a null one."""
    rng = np.random.default_rng(5)
    cloud = rng.uniform(-6, 6, (600, 3))
    motion = rigid.exp(np.array([0.1, -0.06, 0.04, 0.004, -0.006, 0.01]))
    moved = rigid.move(motion, cloud)
    broken = [(1, 50, 900, None, 0.0, 0.0, "x"), (1, 50, 901, float("nan"), 0.0, 0.0, "x"), (1, 50, 902, 0.0, float("inf"), 0.0, "x")]
    a = rows(1, cloud) + rows(1, cloud[:50]) + broken + rows(2, cloud[:2]) + rows(3, cloud) + rows(4, cloud) + rows(5, cloud)
    b = rows(1, moved) + broken + rows(2, cloud[:2]) + rows(3, cloud, 100.0) + rows(5, cloud) + rows(6, cloud)
    guesses = [(k, STILL) for k in (1, 2, 3, 4, 7)] + [(5, None)]
    a, b = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    got = {r.pair_id: r for r in joint_icp.icp_rounds(a, b, spark.createDataFrame(guesses, "pair_id bigint, pose array<double>")).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 7}
    assert np.allclose(got[1].pose, rigid.icp(cloud, moved, np.eye(4))[:3].ravel(), atol=1e-9)
    assert got[1].converged and got[1].rounds > 1
    assert all(got[k].pose == STILL and got[k].rounds == 0 and not got[k].converged for k in (2, 3, 4, 7))
    assert got[5].pose is None


def test_steps_and_empty_tables(spark, sides):
    a, b, guess = sides
    once = joint_icp.icp_rounds(a, b, guess, steps=1).agg(F.max("rounds"), F.max("converged")).first()
    assert tuple(once) == (1, False)
    none = spark.createDataFrame([], SCHEMA)
    assert joint_icp.icp_rounds(none, none, guess.limit(0)).count() == 0
    assert joint_icp.icp_rounds(none, b, guess).where("rounds = 0").count() == guess.count()


def test_what_is_met_is_not_exchanged(spark, sides):
    a, b, guess = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = by_scan(joint_icp.around_voxels(b), *joint_icp.VOXEL)
        source = cut(a.select("pair_id", "pt_idx", "x", "y", "z"))
        plan = joint_icp.matches(source, held, guess)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_voxel = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "vx#" in line]
    assert len(by_voxel) == 1 and "Exchange hashpartitioning" not in plan[plan.index("kept_") - 400 : plan.index("kept_")]
    most = held.agg(F.max(F.size("held"))).first()[0]
    assert most <= 27 * rigid.ICP_CAP
