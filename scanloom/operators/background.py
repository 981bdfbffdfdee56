"""Background grids, and the scan descriptor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.labels import BUILDING, ROAD, cell_priority, is_background
from ..functions.vectors import TINY

# The polar grid.
RINGS, SECTORS, NEAREST, FARTHEST = 24, 360, 5.0, 50.0
GRAPH_SLOTS = 183


def cells(points: DataFrame) -> DataFrame:
    """Background points of the ring area with ring and sector."""
    x, y = F.col("x"), F.col("y")
    r = g.xy_range(x, y)
    width = (FARTHEST - NEAREST) / RINGS
    return (
        points.where(is_background(F.col("label")))
        .withColumn("r", r)
        .where((F.col("r") >= NEAREST) & (F.col("r") < FARTHEST))
        .select(
            "*",
            ((F.col("r") - NEAREST) / F.lit(width)).cast("int").alias("ring"),
            (g.azimuth(x, y) / F.lit(360.0 / SECTORS)).cast("int").alias("sector"),
        )
    )


def polar_grid(points: DataFrame, key: str = "scan_id") -> DataFrame:
    """Occupied cells with the strongest class in each."""
    best = F.max_by("label", cell_priority(F.col("label"))).alias("label")
    return cells(points).groupBy(key, "ring", "sector").agg(best)


def ring_occupancy(points: DataFrame) -> DataFrame:
    """Non-zero slots of occupied sectors per ring: buildings, then roads; L2."""
    offset = F.when(F.col("label") == BUILDING, F.lit(0)).otherwise(F.lit(RINGS))
    seen = cells(points.where(F.col("label").isin(BUILDING, ROAD))).select("scan_id", (offset + F.col("ring")).alias("slot"), "sector").distinct()
    counts = seen.groupBy("scan_id", "slot").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("scan_id")))
    return counts.select("scan_id", "slot", (F.col("n") / norm).alias("value"))


def grid_similarity(a: DataFrame, b: DataFrame, key: str = "pair_id") -> DataFrame:
    """Of the cells that either grid occupies, the share of equal classes. Pairs
    without such a cell have no row."""
    joined = a.select(key, "ring", "sector", F.col("label").alias("la")).join(
        b.select(key, "ring", "sector", F.col("label").alias("lb")), [key, "ring", "sector"], "full"
    )
    same = F.count_if(F.col("la") == F.col("lb"))
    return joined.groupBy(key).agg(same.alias("n_equal"), F.count("*").alias("n_cells")).withColumn("similarity", F.try_divide("n_equal", "n_cells"))


def scan_descriptors(graph: DataFrame, rings: DataFrame) -> DataFrame:
    """Non-zero slots of the 231 of a scan: graph part, ring part, L2-normalised.
    Scans without an edge or a ring still have what the other part gives."""
    every = graph.select("scan_id", "slot", "value").unionByName(rings.select("scan_id", (F.col("slot") + GRAPH_SLOTS).alias("slot"), "value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("scan_id")))
    return every.select("scan_id", "slot", (F.col("value") / F.when(norm == 0, F.lit(TINY)).otherwise(norm)).alias("value"))


def dense(slots: DataFrame, size: int, key: str = "scan_id") -> DataFrame:
    """Slots as one array<float> per key."""
    return (
        slots.groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
        .select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("vec"))
    )
