"""Geometry as column expressions: grids, spherical coordinates, rigid motions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elevation of the lowest row of the spherical grid, degrees, and its extent.
LOWEST, EXTENT = 24.8, 26.8


def voxel(x: Column, size: float) -> Column:
    """Grid index, truncated toward zero: the cells that touch 0 are twice as wide."""
    return (x / F.lit(float(size))).cast("int")


def voxels(size: float, *axes: Column) -> list[Column]:
    return [voxel(a, size).alias(f"v{n}") for a, n in zip(axes, "xyz", strict=True)]


def neighbours27(vx: Column, vy: Column, vz: Column) -> Column:
    """The 27 voxels around one, as an array of structs to explode."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return F.flatten(
        F.transform(
            steps,
            lambda i: F.flatten(
                F.transform(steps, lambda j: F.transform(steps, lambda k: F.struct((vx + i).alias("vx"), (vy + j).alias("vy"), (vz + k).alias("vz"))))
            ),
        )
    )


def xy_range(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def azimuth(x: Column, y: Column) -> Column:
    """Horizontal angle in [0, 360), 0 at the origin."""
    angle = F.degrees(F.atan2(y, x))
    turned = F.when(angle < 0, angle + 360.0).otherwise(angle)
    return F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned)


def elevation(z: Column, r: Column) -> Column:
    return F.degrees(F.atan2(z, r))


def grid_rows(delta: float) -> int:
    return int(EXTENT / delta) + 1


def grid_columns(delta: float) -> int:
    return round(360 / delta)


def spherical_voxel(azimuth_: Column, elevation_: Column, r: Column, r_min: Column, deltas: tuple[float, float, float]) -> dict[str, Column]:
    """Row, column and range index of the curved voxels; deltas: elevation, range, azimuth."""
    d_row, d_range, d_col = deltas
    return {
        "vrow": ((elevation_ + LOWEST) / F.lit(float(d_row))).cast("int"),
        "vcol": (azimuth_ / F.lit(float(d_col))).cast("int"),
        "vrng": ((r - r_min) / F.lit(float(d_range))).cast("int"),
    }


def transform(pose: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Points moved by a row-major 3x4 pose array."""
    return [pose[4 * i] * x + pose[4 * i + 1] * y + pose[4 * i + 2] * z + pose[4 * i + 3] for i in range(3)]


def rotate(pose: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [pose[4 * i] * x + pose[4 * i + 1] * y + pose[4 * i + 2] * z for i in range(3)]


def inverse(pose: Column) -> Column:
    """The inverse of a rigid pose: R', -R't."""
    rows = []
    for i in range(3):
        column = [pose[4 * k + i] for k in range(3)]
        moved = -(column[0] * pose[3] + column[1] * pose[7] + column[2] * pose[11])
        rows += [*column, moved]
    return F.array(*rows)


def rotation_error(a: Column, b: Column) -> Column:
    """Angle between the rotations of two poses, degrees."""
    trace = sum((a[4 * i + k] * b[4 * i + k] for i in range(3) for k in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1.0) / 2.0))))


def translation_error(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[i] - b[i]) * (a[i] - b[i]) for i in (3, 7, 11)), F.lit(0.0)))


def tilt(x: Column, y: Column, z: Column, degrees: float = 0.205) -> list[Column]:
    """A point turned by a small vertical angle, about the axis point x (0, 0, 1)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    r = xy_range(x, y)
    wide = c - F.when(r > 0, s * z / r).otherwise(F.lit(0.0))
    return [x * wide, y * wide, c * z + s * r]


def pad_name(number: Column, length: int) -> Column:
    """Zero-padded; longer numbers stay as they are (lpad alone would cut them)."""
    text = number.cast("string")
    return F.when(F.length(text) >= length, text).otherwise(F.lpad(text, length, "0"))
