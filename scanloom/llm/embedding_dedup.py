"""Near-duplicate embeddings by PCA-ordered tiled comparison (operator 13).

Vectors are linked if their cosine, in double precision, reaches a threshold; a class is
the transitive closure of links.

1. Equal vectors are one node with their number and least id, so copies cost one row.
2. The second moments of all unit vectors, added up over the tasks, give their principal
   axes. A rotation onto these keeps every product, and puts what tells vectors apart
   into the leading dimensions.
3. Nodes are numbered along the first axis and cut into blocks of BLOCK. The angle of two
   vectors is at least the difference of their angles to the axis, so blocks too far
   apart are never compared; every other pair of blocks is a group of its own, and so the
   largest task has two blocks, whatever the data.
4. In a group, tiles of products over the LEAD leading dimensions are formed. What the
   residual dimensions can add is at most the product of the suffixes' norms; with the
   norm as one more dimension, one matrix product gives the bound of every pair in a tile.
   Pairs that it rules out stop there. The others go on, STEP dimensions at a time with
   the suffix norms left, and what remains is decided on the vectors as given.
5. A group returns counts of links and a spanning forest of them, a row for each node
   that has a link: pairs of a large class are counted where they are found, not written.

Vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing, not even their copies. A shorter vector is compared as if it had zeros behind it.
The least id of a class is null only if it has no other; equal rows are vectors like
others and are linked with each other. Numbers of any type are taken as doubles. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.unions import unite
from ..operators.ordering import numbered
from .common import join_groups, least_of_components, quoted, shuffled, spool
from .components import components

THRESHOLD = 0.9
#: Vectors of a block, rows of a tile, pairs whose products are formed at a time.
BLOCK, TILE, PAIRS = 4096, 512, 1 << 15
#: Dimensions of the first product and of each further one.
LEAD, STEP = 16, 16
#: Far more than the rounding errors of bounds, which are in single precision.
SLACK = 1e-4


def is_valid(vector: Column) -> Column:
    """Whether a vector can have a cosine."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows of size doubles, each scaled by a power of two to a largest
    component of about 1, so that no product overflows or vanishes."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def principal_axes(nodes: DataFrame, size: int) -> np.ndarray:
    """The axes (columns) of the unit vectors in v, the widest first. A task adds up
    size x size numbers, and as many come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            unit = units(matrix(batch.column(0), size))
            total += unit.T @ unit
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "m"])

    moments = np.zeros((size, size))
    for i, j, m in nodes.select("v").mapInArrow(run, "i bigint, j bigint, m double").groupBy("i", "j").agg(F.sum("m")).collect():
        moments[i, j] = moments[j, i] = m
    return np.linalg.eigh(moments)[1][:, ::-1]


def _along(nodes: DataFrame, axis: np.ndarray) -> DataFrame:
    """nodes with c, the cosine of v and the axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = units(matrix(batch.column("v"), len(axis))) @ axis
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c)], [*batch.schema.names, "c"])

    return nodes.mapInArrow(run, StructType([*nodes.schema.fields, StructField("c", DoubleType())]))


def block_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """placed(block, c): pairs (i, j), i <= j, of blocks that may hold a link."""
    ends = placed.groupBy("block").agg(F.acos(F.greatest(F.min("c"), F.lit(-1.0))).alias("far"), F.acos(F.least(F.max("c"), F.lit(1.0))).alias("near"))
    ends = spool(ends, "blocks")
    last = ends.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0]
    each = ends.select(F.col("block").alias("i"), F.col("near").alias("near_i"), F.explode(F.sequence("block", F.lit(last))).alias("j"))
    # blocks are numbered by falling angle
    gap = F.col("near_i") - F.col("far")
    return each.join(ends.withColumnRenamed("block", "j"), "j").where(gap <= math.acos(threshold) + SLACK).select("i", "j")


def _found(x: np.ndarray, y: np.ndarray, same: bool, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i of x and j of y, a number of pairs at a time, that are linked; same: x is y,
    and i < j."""
    sides = []
    edges = [*range(LEAD, x.shape[1], STEP), x.shape[1]]
    for side in (x, y):
        turned = units(side) @ axes
        rest = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
        rest = np.sqrt(np.concatenate([rest, np.zeros((len(side), 1))], axis=1)[:, edges])
        bound = np.concatenate([turned[:, : edges[0]], rest[:, :1]], axis=1).astype(np.float32)
        sides.append((turned, rest, bound, np.sqrt(np.einsum("ij,ij->i", side, side))))
    (turned_x, rest_x, bound_x, norm_x), (turned_y, rest_y, bound_y, norm_y) = sides
    for at in range(0, len(x), TILE):
        left = at if same else 0
        tile = bound_x[at : at + TILE] @ bound_y[left:].T
        rows, cols = np.nonzero(tile >= threshold - SLACK)
        rows, cols = rows + at, cols + left
        if same:
            rows, cols = rows[rows < cols], cols[rows < cols]
        for p in range(0, len(rows), PAIRS):
            i, j = rows[p : p + PAIRS], cols[p : p + PAIRS]
            product = np.einsum("ij,ij->i", turned_x[i, : edges[0]], turned_y[j, : edges[0]])
            for e, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
                product += np.einsum("ij,ij->i", turned_x[i, low:high], turned_y[j, low:high])
                may = product + rest_x[i, e] * rest_y[j, e] >= threshold - SLACK
                i, j, product = i[may], j[may], product[may]
            linked = np.einsum("ij,ij->i", x[i], y[j]) / (norm_x[i] * norm_y[j]) >= threshold
            if linked.any():
                yield i[linked], j[linked]


def links(nodes: DataFrame, axes: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """nodes(pos, block, group_size, c, v): rows (pos, n, root): n vectors, copies
    included, that a node is linked with, and a node that it is connected to; a node may
    have several rows."""
    size = len(axes)

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i_block, j_block = (k.as_py() for k in key)
        pos, own, sizes = (rows[c].to_numpy() for c in ("pos", "block", "group_size"))
        vectors = matrix(rows["v"].combine_chunks(), size)
        at = np.flatnonzero(own == i_block)
        to = np.flatnonzero(own == j_block)
        count, root = np.zeros(len(pos), np.int64), np.arange(len(pos))
        for i, j in _found(vectors[at], vectors[to], i_block == j_block, axes, threshold):
            i, j = at[i], to[j]
            np.add.at(count, i, sizes[j])
            np.add.at(count, j, sizes[i])
            root = unite(root, i, j)
        some = np.flatnonzero(count)
        return pa.table({"pos": pos[some], "n": count[some], "root": pos[root[some]]})

    pairs = block_pairs(nodes.select("block", "c"), threshold)
    members = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    spread = nodes.select("pos", "block", "group_size", "v").join(shuffled(members), "block")
    return spread.groupBy("i", "j").applyInArrow(compare, "pos bigint, n bigint, root bigint")


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id
    (the least id of its class) and kept, whether that is its own. threshold: above 0."""
    rows = table.select(F.col(quoted(id_col)).alias("vec_id"), F.col(quoted(vector_col)).alias("v"))
    good = rows.where(is_valid(F.col("v")))
    nodes = spool(good.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("group_size")), "vectors")
    size, n = nodes.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    bad = rows.where(~is_valid(F.col("v"))).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n:
        axes = principal_axes(nodes, size)
        placed = numbered(_along(nodes, axes[:, 0]), F.col("c"), F.col("first_id"))
        placed = spool(placed.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)), "placed")
        found = spool(links(placed, axes, threshold), "links")
        counts = found.groupBy("pos").agg(F.sum("n").alias("n"))
        roots = components(found.select(F.col("pos").alias("a"), F.col("root").alias("b")))
        known = placed.select(F.col("pos").alias("fp"), "first_id", "group_size", "v")
        known = known.join(shuffled(counts.withColumnRenamed("pos", "fp")), "fp", "left").join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left")
        classes = spool(least_of_components(known.withColumn("root", F.coalesce("root", "fp"))), "classes")
        n_links = F.coalesce("n", F.lit(0)) + F.col("group_size") - 1
        bad = join_groups(good, classes, "v", n).select("vec_id", n_links.alias("n_links"), "component_id").unionByName(bad)
    return bad.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_tiles(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Classes are a closure over all pairs; the query is tested against a brute-force version.
ORACLE = None
