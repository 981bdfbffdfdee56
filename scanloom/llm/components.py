"""Connected components of a graph given as links, by star contraction.

Links are dealt to tasks, PART to each, and a task replaces its own by stars: each node
linked to the least that these links connect it with. If that took one task, they are the
components. Otherwise a round links every node to the least node it knows (large star,
then small star), and so on until nothing changes: a number of rounds in the order of the
logarithm of the longest path. A round has some eight exchanges, each a job of its own
that leaves its plan and its threads in the driver for a while; a graph that one task can
hold has none. Rounds are spooled to the shared folder, nothing is collected but counts
and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.unions import unite
from .common import drop_spool, shuffled, spool

#: Links that a task holds at a time.
PART = 1 << 19


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (v, u) as stars (v, u), u the least node of each; PART of them at a time."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1) for b in held]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        i, j = np.split(at, 2)
        root = unite(np.arange(len(nodes)), i, j)
        below = root != np.arange(len(nodes))
        kind = held[0].column(0).type
        return pa.RecordBatch.from_arrays([pa.array(nodes[below], kind), pa.array(nodes[root[below]], kind)], ["v", "u"])

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            if n and n + part.num_rows > PART:
                yield told(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield told(held)


def _minima(links: DataFrame) -> DataFrame:
    """For each node u of links(u, v), the least of itself and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b), any order, repeated or not. One row (node, root) for each node
    that has a link to another; root is the least node of its component."""
    now = spool(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")), "links")
    kind, state, n = dict(now.dtypes)["v"], None, now.count()
    while True:
        parts = -(-n // PART)
        stars = spool(now.coalesce(max(1, parts)).mapInArrow(_stars, f"v {kind}, u {kind}"), "links")
        drop_spool(now)
        now = stars
        if parts < 2:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = both.join(shuffled(_minima(both)), "u").where("v > u").select("v", F.col("m").alias("u")).distinct()
        # small star: every node's links go down; each lower neighbour is linked to the least of them
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(shuffled(least), "u").select(F.col("v").alias("v"), F.col("m").alias("u")).where("v <> u")
        small = small.unionByName(least.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        after = spool(small, "links")
        new = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        drop_spool(now)
        now = after
        if state == tuple(new):
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state, n = tuple(new), new[0]
