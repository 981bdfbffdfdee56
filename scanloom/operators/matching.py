"""Node matching between two scans: gated pairs, optimal assignment, triangles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KITTI, Config
from ..functions.unions import unite
from ..functions.vectors import cosine
from ..plans.store import dealt

MAX_COST = 0.5
# Fewer matches are not pruned; tolerance of triangle sides.
BYPASS, SIDE_LIMIT = 15, 0.25


def size_gated_pairs(a: DataFrame, b: DataFrame, config: Config = KITTI) -> DataFrame:
    """a, b(pair_id, node_id, cls, dx, dy, dz, ...): node pairs of one class whose sizes
    differ by at most box_limit; columns of a begin with a_, those of b with b_. An
    equi-join."""
    keys = ("pair_id", "cls")
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    fits = F.lit(True)
    for c in ("dx", "dy", "dz"):
        fits = fits & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= config.box_limit)
    return left.join(right, list(keys)).where(fits)


def gated_pairs(a: DataFrame, b: DataFrame, config: Config = KITTI) -> DataFrame:
    """a, b(pair_id, node_id, cls, dx, dy, dz, desc): the pairs of size_gated_pairs()
    whose cosine cost is at most MAX_COST."""
    cost = F.greatest(F.lit(0.0), 1.0 - cosine(F.col("a_desc"), F.col("b_desc")))
    columns = ("pair_id", "node_id", "cls", "dx", "dy", "dz", "desc")
    return size_gated_pairs(a.select(*columns), b.select(*columns), config).select("pair_id", "a_node_id", "b_node_id", cost.alias("cost")).where(F.col("cost") <= MAX_COST)


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row its column (-1: none) of a matching of the least total cost, by
    shortest augmenting paths with potentials, O(n^2 m)."""
    if not cost.size:
        return np.full(len(cost), -1, dtype=np.int64)
    if cost.shape[0] > cost.shape[1]:
        by_column = assign(cost.T)
        out = np.full(len(cost), -1, dtype=np.int64)
        out[by_column[by_column >= 0]] = np.flatnonzero(by_column >= 0)
        return out
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1, dtype=np.int64)
    for row in range(n):
        reach, previous = np.full(m, np.inf), np.full(m, -1, dtype=np.int64)
        done = np.zeros(m, dtype=bool)
        at, column, far = row, -1, 0.0
        visited = []
        while True:
            slack = far + cost[at] - u[at] - v
            better = ~done & (slack < reach)
            reach[better], previous[better] = slack[better], column
            nearest = int(np.argmin(np.where(done, np.inf, reach)))
            far, column = reach[nearest], nearest
            done[column] = True
            visited.append(column)
            if owner[column] < 0:
                break
            at = int(owner[column])
        for c in visited[:-1]:
            u[owner[c]] += far - reach[c]
            v[c] -= far - reach[c]
        u[row] += far
        while column >= 0:
            before = int(previous[column])
            owner[column] = owner[before] if before >= 0 else row
            column = before
    out = np.full(n, -1, dtype=np.int64)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def components(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each edge between node a[i] of one side and b[i] of the other (both counted from
    0) the number of its connected component."""
    n = int(a.max(initial=-1)) + 1
    root = unite(np.arange(n + int(b.max(initial=-1)) + 1), a, n + b)
    return np.unique(root[a], return_inverse=True)[1]


def assign_edges(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The places of the edges of a matching that has as many edges as can be and, of those,
    the least total cost. Components are solved one by one: stars at once, others by a
    matrix of their own size, in which a missing edge costs more than all others together."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    part = components(a, b)
    order = np.lexsort((b, a, cost, part))
    ends = np.flatnonzero(np.diff(part[order], append=-1))
    chosen, start = [], 0
    for end in ends:
        own = order[start : end + 1]
        start = end + 1
        rows, i = np.unique(a[own], return_inverse=True)
        columns, j = np.unique(b[own], return_inverse=True)
        if len(rows) == 1 or len(columns) == 1:
            chosen.append(own[:1])
            continue
        edge = np.full((len(rows), len(columns)), -1, dtype=np.int64)
        places, first = np.unique(i * len(columns) + j, return_index=True)
        edge.flat[places] = own[first]  # of repeated edges the cheapest
        table = np.full(edge.shape, 1.0 + min(edge.shape) * cost[own[-1]])
        table[edge >= 0] = cost[edge[edge >= 0]]
        found = assign(table)
        picked = edge[np.flatnonzero(found >= 0), found[found >= 0]]
        chosen.append(picked[picked >= 0])
    return np.concatenate(chosen)


def best_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of each pair of scans: as many as can be, and of those the least
    total cost. Pairs of nodes that the gate leaves out are never matched. A group is the
    gated node pairs of one pair of scans, whose numbers of nodes a sensor bounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in ("a_node_id", "b_node_id"))
        own = pdf.iloc[assign_edges(a, b, pdf.cost.to_numpy(dtype=np.float64))]
        return pd.DataFrame({"pair_id": own.pair_id, "node_a": own.a_node_id, "node_b": own.b_node_id, "cost": own.cost})

    return dealt(pairs, "pair_id").groupBy("pair_id").applyInPandas(run, "pair_id bigint, node_a int, node_b int, cost double")


def triangles(nodes: DataFrame, centres: DataFrame, limit: float) -> DataFrame:
    """nodes(pair_id, match_id, node_id), centres(pair_id, node_id, cx, cy, cz): for
    each node the sorted sides of its triangles with two neighbours nearer than
    limit, and the number of its neighbours."""
    own = centres.select("pair_id", "node_id", *[F.col(c).alias(f"o{c[1]}") for c in ("cx", "cy", "cz")])
    other = centres.select("pair_id", F.col("node_id").alias("other"), "cx", "cy", "cz")
    gap = lambda a, b: F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
    near = (
        nodes.join(own, ["pair_id", "node_id"])
        .join(other, "pair_id")
        .where(F.col("other") != F.col("node_id"))
        .withColumn("side", gap(("ox", "oy", "oz"), ("cx", "cy", "cz")))
        .where((F.col("side") < limit) & (F.col("side") != 0))
        .select("pair_id", "match_id", "other", "cx", "cy", "cz", "side")
    )
    count = near.groupBy("pair_id", "match_id").agg(F.count("*").alias("n_near"))
    second = near.select("pair_id", "match_id", F.col("other").alias("other2"), *[F.col(c).alias(f"{c}2") for c in ("cx", "cy", "cz")], F.col("side").alias("side2"))
    both = near.join(second, ["pair_id", "match_id"]).where(F.col("other") < F.col("other2"))
    sides = F.array_sort(F.array("side", "side2", gap(("cx", "cy", "cz"), ("cx2", "cy2", "cz2"))))
    return both.select("pair_id", "match_id", sides.alias("s")).join(count, ["pair_id", "match_id"])


def prune(matches: DataFrame, a: DataFrame, b: DataFrame, config: Config = KITTI) -> DataFrame:
    """matches(pair_id, match_id, node_a, node_b) with n_triangles and kept: matches
    whose nodes have enough triangles in common. Fewer than BYPASS matches of a pair
    of scans are all kept."""
    one = triangles(matches.select("pair_id", "match_id", F.col("node_a").alias("node_id")), a, config.triangle_limit)
    two = triangles(matches.select("pair_id", "match_id", F.col("node_b").alias("node_id")), b, config.triangle_limit)
    two = two.select("pair_id", "match_id", F.col("s").alias("t"), F.col("n_near").alias("n_near_b"))
    alike = F.lit(True)
    for i in range(3):
        alike = alike & (F.abs(F.col("s")[i] - F.col("t")[i]) < SIDE_LIMIT)
    met = one.join(two, ["pair_id", "match_id"]).where(alike)
    counted = met.groupBy("pair_id", "match_id").agg(F.count("*").alias("n_triangles"), F.min("n_near").alias("near_a"), F.min("n_near_b").alias("near_b"))
    sizes = matches.groupBy("pair_id").agg(F.count("*").alias("n_matches"))
    needed = F.when((F.col("near_a") > 3) & (F.col("near_b") > 3), F.lit(config.triangles_needed)).otherwise(F.lit(1))
    enough = F.coalesce(F.col("n_triangles") >= needed, F.lit(False))
    return (
        matches.join(counted, ["pair_id", "match_id"], "left")
        .join(sizes, "pair_id")
        .select(*matches.columns, F.coalesce("n_triangles", F.lit(0)).alias("n_triangles"), ((F.col("n_matches") < BYPASS) | enough).alias("kept"))
    )
