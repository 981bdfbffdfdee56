"""Instances: connected components of curved voxels, and their boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KITTI, Config
from ..functions import geometry as g
from ..functions.labels import is_foreground, node_class
from ..functions.unions import unite
from ..plans.store import cut, dealt

MIN_POINTS = 10


def spherical(points: DataFrame) -> DataFrame:
    """points with azimuth, elevation (degrees) and xy range."""
    x, y, z = (F.col(c) for c in "xyz")
    r = g.xy_range(x, y)
    return points.select("*", g.azimuth(x, y).alias("azimuth"), g.elevation(z, r).alias("elevation"), r.alias("xy_range"))


def spherical_voxels(points: DataFrame, config: Config = KITTI) -> DataFrame:
    """points with their curved voxel. The range grid of a scan's class starts at
    the class's own least range, so that is an aggregate joined back by the group
    (a window would sort all points)."""
    polar = spherical(points)
    least = polar.groupBy("scan_id", "label").agg(F.min("xy_range").alias("r_min"))
    cells = g.spherical_voxel(F.col("azimuth"), F.col("elevation"), F.col("xy_range"), F.col("r_min"), config.deltas)
    joined = polar.join(least, ["scan_id", "label"])
    return joined.select(*polar.columns, *[e.alias(k) for k, e in cells.items()])


def _components(cells: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The number of the least cell of each cell's component. Cells (row, column,
    range) touch if no index differs by more than one; columns go round. Of two
    cells one must lie in a row of the grid; a cell beyond it touches nothing else.
    Cells are numbers, and neighbours are looked up for all of them at once, a step at
    a time."""
    if not len(cells):
        return np.zeros(0, dtype=np.int64)
    row, column, rng = (cells[:, i].astype(np.int64) for i in range(3))
    low, width = rng.min() - 1, rng.max() - rng.min() + 3
    lowest = row.min() - 1
    code = lambda r, c, d: ((r - lowest) * columns + c) * width + d - low
    own = code(row, column, rng)
    order = np.argsort(own)
    known = own[order]
    inside = np.flatnonzero((row >= 0) & (row < rows))
    root = np.arange(len(cells))
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            for c in (-1, 0, 1):
                asked = code(row[inside] + a, (column[inside] + b) % columns, rng[inside] + c)
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                met = known[at] == asked
                root = unite(root, inside[met], order[at[met]])
    return root


def components(voxels: DataFrame, config: Config = KITTI) -> DataFrame:
    """voxels(scan_id, label, vrow, vcol, vrng), distinct: with component, the least
    voxel of the component as one number. A group is one class of one scan, whose
    size a sensor bounds."""
    rows, columns = g.grid_rows(config.delta_elevation), g.grid_columns(config.delta_azimuth)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vrow", "vcol", "vrng"], ignore_index=True)
        found = _components(pdf[["vrow", "vcol", "vrng"]].to_numpy(), rows, columns)
        first = pdf.iloc[found].reset_index(drop=True)
        code = ((first.vrow.astype("int64") + 100) * 1000 + first.vcol) * 1_000_000 + first.vrng
        inside = pdf.vrow.between(0, rows - 1).to_numpy()
        alone = ~inside & (found == np.arange(len(pdf))) & (np.bincount(found, minlength=len(pdf))[found] == 1)
        return pdf.assign(component=code)[~alone]

    schema = "scan_id bigint, label int, vrow int, vcol int, vrng int, component bigint"
    narrow = voxels.select(F.col("scan_id").cast("bigint"), F.col("label").cast("int"), "vrow", "vcol", "vrng").distinct()
    return dealt(cut(narrow), "scan_id", "label").groupBy("scan_id", "label").applyInPandas(run, schema)


def clusters(points: DataFrame, config: Config = KITTI) -> DataFrame:
    """Foreground points with their component. Only distinct voxels go to Python.
    Points outside the grid that touch nothing are dropped, as they never make up
    an instance."""
    gridded = spherical_voxels(points.where(is_foreground(F.col("label"))), config)
    return gridded.join(components(gridded, config), ["scan_id", "label", "vrow", "vcol", "vrng"])


def instances(clustered: DataFrame, size_check: bool = False) -> DataFrame:
    """Boxes of components of at least MIN_POINTS points: node_id, class, centre,
    size and count. size_check (for poses): vehicles of at least 0.5 x 0.5 x 0.3 m,
    trunks and poles of at least 0.3 m height."""
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = clustered.groupBy("scan_id", "label", "component").agg(F.count("*").alias("n"), *ends).where(F.col("n") >= MIN_POINTS)
    boxes = boxes.select(
        "scan_id",
        node_class(F.col("label")).alias("cls"),
        *[((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2).alias(f"c{c}") for c in "xyz"],
        *[(F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias(f"d{c}") for c in "xyz"],
        "n",
        "component",
        "label",
    )
    if size_check:
        vehicle = (F.col("dx") >= 0.5) & (F.col("dy") >= 0.5) & (F.col("dz") >= 0.3)
        boxes = boxes.where(F.when(F.col("cls") == 1, vehicle).otherwise(F.col("dz") >= 0.3))
    order = Window.partitionBy("scan_id").orderBy("cls", "cx", "cy", "cz", "label", "component")
    return boxes.withColumn("node_id", F.row_number().over(order) - 1).drop("component", "label")


def large_clusters(clustered: DataFrame, least: int = 10) -> DataFrame:
    """Clusters of over so many points, the largest first within each scan."""
    counted = clustered.groupBy("scan_id", "label", "component").agg(F.count("*").alias("n")).where(F.col("n") > least)
    order = Window.partitionBy("scan_id").orderBy(F.col("n").desc(), "label", "component")
    return counted.withColumn("place", F.row_number().over(order))


def visit_order_clusters(cells: list[tuple[int, int, int]], neighbours) -> list[int]:
    """Cluster numbers of points visited in order, by the rule that a point which
    already has a cluster is never expanded: finer than components. cells: voxel of
    each point; neighbours(cell): the cells around it."""
    at: dict[tuple, list[int]] = {}
    for i, cell in enumerate(cells):
        at.setdefault(cell, []).append(i)
    own = [-1] * len(cells)
    fresh = 0
    for i, cell in enumerate(cells):
        if own[i] >= 0:
            continue
        group = [j for c in neighbours(cell) for j in at.get(c, ())]
        met = {own[j] for j in group if own[j] >= 0}
        if met:
            number = min(met)
            if len(met) > 1:
                own = [number if o in met else o for o in own]
        else:
            number, fresh = fresh, fresh + 1
        own[i] = number
        for j in group:
            own[j] = number
    return own
