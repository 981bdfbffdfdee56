"""Top-k similarity join with an exclusion window.

Every query is compared with all scans that lie more than `exclusion` ids before
it. Scans are cut into blocks of about equal numbers by their ids, and a pair of blocks is
one group. As blocks grow with the table, up to BLOCK_VALUES numbers, their number doesn't,
nor do the copies of a scan (one for each block) and a query's candidates (k from each);
the distances that are computed grow with the square of the number of scans. A task holds
two blocks and compares a few hundred queries with a few thousand scans at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nearest
from ..functions.nearest import Nearest

K, EXCLUSION = 50, 100
#: Blocks of a table, unless that makes them smaller than BLOCK rows or larger than BLOCK_VALUES.
BLOCKS, BLOCK, BLOCK_VALUES = 16, 512, 1 << 22
# The candidate and distance that fill up short lists.
NO_CANDIDATE, NO_DISTANCE = -1, 2.0
DIGITS = nearest.DIGITS
FOUND = pa.schema([("query_id", pa.int64()), ("cand_id", pa.int64()), ("d2", pa.float64())])


def usable(vectors: DataFrame) -> DataFrame:
    """Of vectors(id, vec) those that have distances: of finite numbers."""
    return vectors.where(F.forall("vec", lambda x: F.abs(x) < float("inf")))


def block_count(rows: int, size: int, least: int = BLOCK) -> int:
    """Of so many vectors of that size."""
    return max(min(BLOCKS, -(-rows // least)), -(-rows * max(size, 1) // BLOCK_VALUES), 1)


def block_ends(vectors: DataFrame, least: int = BLOCK) -> list[int]:
    """The largest id of each block of vectors(id, vec) but the last."""
    rows, size = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    blocks = block_count(rows, size or 1, least)
    if blocks == 1:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    return sorted(set(vectors.agg(F.percentile_approx("id", shares, max(10_000, 20 * blocks))).first()[0]))


def block_of(ends: list[int]) -> Column:
    """The block of an id, from 0."""
    return F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e < F.col("id"))) if ends else F.lit(0)


def as_found(parts: list) -> pa.Table:
    """Results of Nearest.found()."""
    if not parts:
        return FOUND.empty_table()
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], schema=FOUND)


def sorted_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and vectors, of those that have distances."""
    table = table.sort_by("id")
    ids, vectors = table.column("id").to_numpy().astype(np.int64), nearest.matrix(table.column("vec"))
    ok = nearest.finite(vectors)
    return ids[ok], vectors[ok]


def _block_candidates(queries: pa.Table, scans: pa.Table, k: int, exclusion: int) -> pa.Table:
    if not len(queries) or not len(scans):
        return FOUND.empty_table()
    (ids, asked), (cands, held) = sorted_rows(queries), sorted_rows(scans)
    found = []
    for at in range(0, len(ids), nearest.ROWS):
        some = Nearest(asked[at : at + nearest.ROWS], ids[at : at + nearest.ROWS], k, exclusion)
        every, end = np.arange(len(some.ids)), np.searchsorted(cands, some.ids[-1] - exclusion)
        for c in range(0, end, nearest.COLUMNS):
            to = min(c + nearest.COLUMNS, end)
            some.see(every, held[c:to], cands[c:to])
        found.append(some.found())
    return as_found(found)


def candidates(scans: DataFrame, k: int = K, exclusion: int = EXCLUSION, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """scans(id, vec): (query_id, cand_id, d2, rk) for queries (default: all scans)
    of an id above the exclusion. d2: squared L2, rounded to DIGITS. A scan goes only
    to blocks from the first to the last with a query, so a few new queries cost one
    copy of the history. block: scans that are not worth cutting."""
    queries, scans = usable(scans if queries is None else queries).where(F.col("id") > exclusion), usable(scans)
    own = block_of(block_ends(scans, block)).alias("own")
    low, top = queries.agg(F.min(own), F.max(own)).first()
    low, top = low or 0, top or 0
    asked = queries.select("id", "vec", own).select("id", "vec", F.col("own").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("cb"))
    held = (
        scans.select("id", "vec", own)
        .where(F.col("own") <= top)
        .select("id", "vec", F.col("own").alias("cb"), F.explode(F.sequence(F.greatest("own", F.lit(low)), F.lit(top))).alias("qb"))
    )

    def compare(q: pa.Table, s: pa.Table) -> pa.Table:
        return _block_candidates(q, s, k, exclusion)

    found = asked.groupBy("qb", "cb").cogroup(held.groupBy("qb", "cb")).applyInArrow(compare, "query_id bigint, cand_id bigint, d2 double")
    order = Window.partitionBy("query_id").orderBy("d2", "cand_id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)


def padded(found: DataFrame, queries: DataFrame, k: int = K, exclusion: int = EXCLUSION) -> DataFrame:
    """Exactly k rows per query id: what is missing is (-1, 2). A query's last candidate
    brings what is missing behind it."""
    asked = queries.where(F.col("id") > exclusion).select(F.col("id").alias("query_id"))
    joined = asked.join(found.select("query_id", "cand_id", "d2", "rk"), "query_id", "left")
    marked = joined.withColumn("last", F.max("rk").over(Window.partitionBy("query_id")))
    first, to = F.coalesce("rk", F.lit(1)), F.when(F.col("rk") < F.col("last"), F.col("rk")).otherwise(F.lit(k))
    slots = marked.withColumn("slot", F.explode(F.sequence(first, to)))
    there = F.col("slot") == F.col("rk")
    return slots.select(
        "query_id",
        F.col("slot").alias("rk"),
        F.when(there, F.col("cand_id")).otherwise(F.lit(NO_CANDIDATE).cast("bigint")).alias("cand_id"),
        F.when(there, F.col("d2")).otherwise(F.lit(NO_DISTANCE)).alias("d2"),
    )
