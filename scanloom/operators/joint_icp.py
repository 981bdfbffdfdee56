"""Point-to-point ICP of all pairs at once, as rounds of joins and sums.

registration.icp_poses gives the points of a pair to one task, which does all its steps.
Here a task never holds a pair: a round moves the thinned points of all pairs that have not
converged by their poses, joins them on voxels with the points around, and adds up the
6 x 6 normal equations of each pair; only those 27 sums are solved, one row a pair. The
poses are those of rigid.icp.

The points to be met are stored once, for each voxel those of the 27 voxels around it (at
most 27 * ICP_CAP), in buckets of (pair, voxel). So a round exchanges each moved point once
and partial sums of pairs (and points by pair before, where there are too many poses for
Spark to broadcast them), and pairs of any size are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rigid
from ..functions.geometry import neighbours27, transform, voxels
from ..plans.store import by_scan, cut
from .registration import POSE, normal_equations
from .voxels import downsample_first, first_per_voxel

VOXEL = ("pair_id", "vx", "vy", "vz")
STATE = f"pair_id bigint, pose {POSE}, rounds int, converged boolean, done boolean"
_CELLS = np.triu_indices(6)
_CUT_OFF = 6 * np.finfo(np.float64).eps


def _thin(points: DataFrame) -> DataFrame:
    """The first point of each small voxel; those without finite coordinates are left out."""
    finite = [F.abs(F.col(c)) < float("inf") for c in "xyz"]
    own = points.select(F.col("pair_id").alias("scan_id"), "pt_idx", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return downsample_first(own.where(finite[0] & finite[1] & finite[2]), rigid.ICP_VOXEL).drop("vx", "vy", "vz")


def around_voxels(points: DataFrame) -> DataFrame:
    """points(pair_id, pt_idx, x, y, z): for each voxel with points in the 27 around it, those
    points (pair_id, vx, vy, vz, held), of each of the 27 the first ICP_CAP."""
    first = first_per_voxel(_thin(points), rigid.ICP_MAP, rigid.ICP_CAP)
    each = first.select(
        F.col("scan_id").alias("pair_id"),
        F.struct("pt_idx", "x", "y", "z").alias("point"),
        F.explode(neighbours27(F.col("vx"), F.col("vy"), F.col("vz"))).alias("v"),
    )
    return each.select("pair_id", "v.*", "point").groupBy(*VOXEL).agg(F.collect_list("point").alias("held"))


def _nearest(held: Column) -> Column:
    """The nearest of held to (sx, sy, sz), of equally near ones that of the least pt_idx."""

    def gap(point: Column) -> Column:
        d2 = sum(((F.col(f"s{c}") - point[c]) * (F.col(f"s{c}") - point[c]) for c in "xyz"), F.lit(0.0))
        return F.struct(d2.alias("d2"), point["pt_idx"].alias("tgt_idx"), *[point[c].alias(f"t{c}") for c in "xyz"])

    return F.array_min(F.transform(held, gap))


def matches(source: DataFrame, held: DataFrame, poses: DataFrame) -> DataFrame:
    """source(pair_id, x, y, z) moved by poses(pair_id, pose), each point with the nearest of
    held within ICP_RADIUS: pair_id, sx .., tx .., d2."""
    moved = source.join(poses.select("pair_id", "pose"), "pair_id").select("pair_id", *[e.alias(f"s{c}") for e, c in zip(transform(F.col("pose"), *map(F.col, "xyz")), "xyz", strict=True)])
    gridded = moved.select("*", *voxels(rigid.ICP_MAP, *[F.col(f"s{c}") for c in "xyz"]))
    # inline: the search is an expression of which several fields are read, and runs once
    found = gridded.join(held, list(VOXEL)).select("pair_id", "sx", "sy", "sz", F.inline(F.array(_nearest(F.col("held")))))
    return found.where(F.col("d2") < rigid.ICP_RADIUS**2)


def _step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State with the sums of its pairs: the state after one step."""
    for state in batches:
        going = (~state.done & (state.n.fillna(0) >= 3)).to_numpy()
        sums = state[going]
        jtj = np.zeros((len(sums), 6, 6))
        jtj[:, _CELLS[0], _CELLS[1]] = jtj[:, _CELLS[1], _CELLS[0]] = sums[[f"h{i}{j}" for i, j in zip(*_CELLS, strict=True)]].to_numpy(dtype=np.float64)
        jtr = sums[[f"b{i}" for i in range(6)]].to_numpy(dtype=np.float64)
        twists = -(np.linalg.pinv(jtj, rcond=_CUT_OFF, hermitian=True) @ jtr[:, :, None])[:, :, 0]
        poses, still = list(state.pose), np.zeros(len(state), dtype=bool)
        for at, twist in zip(np.flatnonzero(going), twists, strict=True):
            step = rigid.exp(twist)
            poses[at] = (step @ np.vstack([np.reshape(poses[at], (3, 4)), [0, 0, 0, 1]]))[:3].ravel()
            still[at] = np.linalg.norm(rigid.log(step)) < rigid.ICP_STOP
        yield pd.DataFrame({
            "pair_id": state.pair_id, "pose": poses, "rounds": state.rounds + going,
            "converged": state.converged | still, "done": state.done | ~going | still,
        })


def icp_rounds(points_a: DataFrame, points_b: DataFrame, guesses: DataFrame, steps: int = rigid.ICP_STEPS) -> DataFrame:
    """ICP of the points of a onto those of b, both (pair_id, pt_idx, x, y, z), from
    guesses(pair_id, pose): pair_id, pose, rounds (steps taken) and converged, a row for each
    pair with a guess. A pair of which fewer than three points meet others stays as it is,
    as do pairs without points and those whose guess is null; of several guesses of a pair
    the least counts."""
    source = cut(_thin(points_a).withColumnRenamed("scan_id", "pair_id"))
    held = by_scan(around_voxels(points_b), *VOXEL)
    one = guesses.groupBy(F.col("pair_id").cast("bigint").alias("pair_id")).agg(F.min("pose").alias("pose"))
    never = F.col("pose").isNull()
    state = cut(one.select("pair_id", "pose", F.lit(0).alias("rounds"), F.lit(False).alias("converged"), never.alias("done")))
    for _ in range(steps):
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            break
        sums = normal_equations(matches(source, held, open_))
        state = cut(state.join(sums, "pair_id", "left").mapInPandas(_step, STATE))
    return state.drop("done")
