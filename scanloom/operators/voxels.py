"""Voxel operators over points(scan_id, pt_idx, x, y, z, label, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rigid
from ..functions.geometry import neighbours27, voxels
from ..functions.labels import PLANES


def downsample_first(points: DataFrame, size: float) -> DataFrame:
    """The first point of each scan's voxel, by pt_idx. One hash aggregation with
    partial minima; no sort of points."""
    columns = [c for c in points.columns if c != "scan_id"]
    first = F.min_by(F.struct(*columns), "pt_idx").alias("p")
    x, y, z = (F.col(c) for c in "xyz")
    return points.groupBy("scan_id", *voxels(size, x, y, z)).agg(first).select("scan_id", "p.*", "vx", "vy", "vz")


def first_per_voxel(points: DataFrame, size: float, cap: int) -> DataFrame:
    """Up to cap points of each voxel, in the order of pt_idx. The rank filter lets
    the planner drop rows before the shuffle."""
    x, y, z = (F.col(c) for c in "xyz")
    gridded = points.select("*", *voxels(size, x, y, z))
    order = Window.partitionBy("scan_id", "vx", "vy", "vz").orderBy("pt_idx")
    return gridded.withColumn("rank_in_voxel", F.row_number().over(order)).where(F.col("rank_in_voxel") <= cap)


def nearest_within(source: DataFrame, target: DataFrame, size: float, radius: float, cap: int) -> DataFrame:
    """For each source point (pair_id, pt_idx, x, y, z) the nearest target point
    (pair_id, pt_idx, x, y, z) of the 27 voxels around it, if nearer than radius.
    An equi-join on voxels; ties go to the smaller target index."""
    x, y, z = (F.col(c) for c in "xyz")
    around = source.select(
        "pair_id", F.col("pt_idx").alias("src_idx"), x.alias("sx"), y.alias("sy"), z.alias("sz"), *voxels(size, x, y, z)
    ).select("pair_id", "src_idx", "sx", "sy", "sz", F.explode(neighbours27(F.col("vx"), F.col("vy"), F.col("vz"))).alias("v"))
    around = around.select("pair_id", "src_idx", "sx", "sy", "sz", "v.*")
    held = first_per_voxel(target.withColumnRenamed("pair_id", "scan_id"), size, cap).select(
        F.col("scan_id").alias("pair_id"), F.col("pt_idx").alias("tgt_idx"), x.alias("tx"), y.alias("ty"), z.alias("tz"), "vx", "vy", "vz"
    )
    d2 = sum(((F.col(f"s{c}") - F.col(f"t{c}")) * (F.col(f"s{c}") - F.col(f"t{c}")) for c in "xyz"), F.lit(0.0))
    found = around.join(held, ["pair_id", "vx", "vy", "vz"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    best = F.min(F.struct("d2", "tgt_idx", "tx", "ty", "tz")).alias("b")
    return found.groupBy("pair_id", "src_idx", "sx", "sy", "sz").agg(best).select("pair_id", "src_idx", "sx", "sy", "sz", "b.*")


def plane_moments(points: DataFrame, size: float, least: int) -> DataFrame:
    """Per voxel of at least so many points: n, means and central second moments."""
    x, y, z = (F.col(c) for c in "xyz")
    sums = {f"s{a}": F.sum(a) for a in "xyz"} | {f"s{a}{b}": F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    grouped = points.groupBy("scan_id", *voxels(size, x, y, z)).agg(F.count("*").alias("n"), *[e.alias(k) for k, e in sums.items()])
    means = {f"m{a}": F.col(f"s{a}") / F.col("n") for a in "xyz"}
    second = {f"c{a}{b}": F.col(f"s{a}{b}") / F.col("n") - means[f"m{a}"] * means[f"m{b}"] for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return grouped.where(F.col("n") >= least).select("scan_id", "vx", "vy", "vz", "n", *[e.alias(k) for k, e in (means | second).items()])


def normals(moments: DataFrame) -> DataFrame:
    """Rows of plane_moments() with their normal, the direction in which the points spread
    least (its largest component is positive), and spread, their variance along it."""
    second = [f"c{a}" for a in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")]
    kept = ["scan_id", "vx", "vy", "vz", "n", "mx", "my", "mz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread, axes = np.linalg.eigh(np.stack([batch.column(c).to_numpy() for c in second], axis=1).reshape(-1, 3, 3))
            normal = axes[:, :, 0]
            lead = np.abs(normal).argmax(axis=1)[:, None]
            normal = normal * np.sign(np.take_along_axis(normal, lead, axis=1))
            columns = [*(batch.column(c) for c in kept), *(pa.array(np.ascontiguousarray(normal[:, i])) for i in range(3)), pa.array(spread[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "nx", "ny", "nz", "spread"])

    types = dict(moments.dtypes)
    return moments.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", nx double, ny double, nz double, spread double")


def planes(points: DataFrame) -> DataFrame:
    """The planes of each scan's road, buildings and fences: centre (mx, my, mz) and normal
    of every voxel with enough points that are flat."""
    thin = downsample_first(points.where(F.col("label").isin(*PLANES)).select("scan_id", "pt_idx", "x", "y", "z"), rigid.PLANE_DOWN)
    moments = plane_moments(thin.drop("vx", "vy", "vz"), rigid.PLANE_VOXEL, rigid.PLANE_POINTS)
    return normals(moments).where(F.col("spread") <= rigid.PLANE_FLAT)
