"""Exact top-k search through pivots and the triangle inequality.

Every vector belongs to the nearest of a few pivots. A pivot's vectors are cut, in the order
of their distance to it, into parts of at most PART, so a part is a range of distances
around a pivot. A query is compared with the part it would lie in itself first; that bounds
the distance of its k-th candidate, and it is then compared only with parts that may hold a
nearer one: |d(query, pivot) - d(vector, pivot)| is at most d(query, vector). The same bound
leaves out vectors within a part. Rows equal those of retrieval.candidates(), ties included.

Neighbouring parts make up a group, and queries a block by their ids, as many as retrieval
has blocks. A query goes once to each group with a part for it, a vector once to each block
that may see it, so neither copies nor a task's rows grow with the number of parts.

The index is a table (kept by build()); new vectors are added to it as parts of their own
with the same pivots. Pivots are the vectors of least hash; their number is bounded and
changes the cost, not the result. Parts are described to the tasks by a row each, one for
PART vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nearest
from ..functions.nearest import Nearest
from ..plans.store import cut
from . import retrieval
from .ordering import numbered

PIVOTS, PART = 64, 512
#: Queries times parts that are bounded at once.
BOUNDED = 1 << 20
#: More than rounding squared distances to retrieval.DIGITS can hide.
SLACK = 2e-6


BOUND = pa.schema([("id", pa.int64()), ("bound", pa.float64())])


@dataclass(frozen=True)
class Index:
    """members(id, vec, r, part): vectors with the distance to their pivot; parts: of each
    its pivot, the least and largest r, the least id and the number of vectors."""

    pivots: np.ndarray
    members: DataFrame
    parts: pd.DataFrame


def _to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(vectors), len(pivots)))
    for i, pivot in enumerate(pivots):  # differences: a product would lose digits of small distances
        gap = vectors - pivot
        out[:, i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _members(scans: DataFrame, pivots: np.ndarray, before: int) -> DataFrame:
    def near(batches):
        for rows in batches:
            rows = pa.Table.from_batches([rows])
            far = _to_pivots(nearest.matrix(rows.column("vec")), pivots)
            at = far.argmin(axis=1)
            rows = rows.append_column("pivot", pa.array(at, pa.int64())).append_column("r", pa.array(far[np.arange(len(at)), at]))
            yield from rows.to_batches()

    types = dict(scans.dtypes)
    placed = scans.select("id", "vec").mapInArrow(near, f"id {types['id']}, vec {types['vec']}, pivot bigint, r double")
    order = [F.col("pivot"), F.col("r"), F.col("id")]
    return numbered(placed, *order).withColumn("part", F.struct("pivot", (F.floor((F.col("pos") - 1) / PART) + before).alias("nth"))).drop("pos")


def _described(members: DataFrame) -> pd.DataFrame:
    found = members.groupBy("part").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.min("id").alias("first_id"), F.count("*").alias("n"))
    return found.select("part.pivot", "part.nth", "low", "high", "first_id", "n").toPandas()


def build(scans: DataFrame, pivots: int = PIVOTS) -> Index:
    """The index of scans(id, vec)."""
    scans = retrieval.usable(scans)
    rows = scans.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").collect()
    chosen = np.array([r.vec for r in rows], dtype=np.float64)
    members = cut(_members(scans, chosen, 0))
    return Index(chosen, members, _described(members))


def add(index: Index, scans: DataFrame) -> Index:
    """The index with more vectors, in parts of their own; the others stay as they are."""
    if not len(index.pivots):
        return build(scans)
    new = cut(_members(retrieval.usable(scans), index.pivots, int(index.parts.nth.max()) + 1))
    return Index(index.pivots, index.members.unionByName(new), pd.concat([index.parts, _described(new)], ignore_index=True))


def _reach(bound: np.ndarray) -> np.ndarray:
    """The distance that a candidate within the bound may have."""
    return np.sqrt(bound + SLACK)


def _asked(queries: DataFrame, parts: pd.DataFrame, pivots: np.ndarray, exclusion: int, first: bool) -> DataFrame:
    """queries(id, vec, qb, bound) with a row for each group that has a part that may hold a
    candidate within the bound; first: only for the group of home, the part in which a
    query would lie or the nearest to that."""
    pivot, low, high, first_id, group = (parts[c].to_numpy() for c in ("pivot", "low", "high", "first_id", "grp"))
    groups, starts = np.unique(group, return_index=True)
    step = max(BOUNDED // len(parts), 1)

    def marked(rows: pa.Table, grp: np.ndarray, home: np.ndarray):
        return rows.append_column("grp", pa.array(grp, pa.int64())).append_column("home", pa.array(home, pa.int64())).to_batches()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = pa.Table.from_batches([batch.slice(at, step)])
                far = _to_pivots(nearest.matrix(rows.column("vec")), pivots)[:, pivot]
                least = np.maximum(np.maximum(far - high, low - far) - 1e-9 * (1 + far + high), 0)
                eligible = first_id[None] < rows.column("id").to_numpy()[:, None] - exclusion
                if first:
                    home = np.where(eligible, least * 1e6 + far, np.inf).argmin(axis=1)
                    q = np.flatnonzero(eligible[np.arange(len(home)), home])
                    yield from marked(rows.take(q), group[home[q]], home[q])
                    continue
                ok = eligible & (least <= _reach(rows.column("bound").to_numpy())[:, None])
                some = np.logical_or.reduceat(ok, starts, axis=1)
                for i, number in enumerate(groups):
                    q = np.flatnonzero(some[:, i])
                    yield from marked(rows.take(q), np.full(len(q), number), np.full(len(q), -1))

    types = dict(queries.dtypes)
    return queries.mapInArrow(run, f"id {types['id']}, vec {types['vec']}, qb int, bound double, grp bigint, home bigint")


def _sorted(table: pa.Table, *order: str) -> dict[str, np.ndarray]:
    table = table.sort_by([(c, "ascending") for c in order])
    columns = {c: table.column(c).to_numpy() for c in table.column_names if c != "vec"}
    return columns | {"id": columns["id"].astype(np.int64), "vec": nearest.matrix(table.column("vec"))}


def search(index: Index, queries: DataFrame, k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION, count=None) -> DataFrame:
    """queries(id, vec): (query_id, cand_id, d2, rk), as retrieval.candidates() has them.
    count: an accumulator of compared pairs."""
    asked = retrieval.usable(queries).where(F.col("id") > exclusion).select("id", "vec")
    if not len(index.parts):
        return asked.select(F.col("id").alias("query_id"), F.col("id").alias("cand_id"), F.lit(0.0).alias("d2"), F.lit(1).alias("rk")).limit(0)
    pivots = index.pivots
    parts = index.parts.sort_values(["pivot", "nth"], ignore_index=True)
    groups = retrieval.block_count(int(parts.n.sum()), pivots.shape[1])
    parts["grp"] = (parts.n.cumsum() - parts.n) * groups // parts.n.sum()
    ends = retrieval.block_ends(asked)
    where = [(int(p.pivot), int(p.nth), p.Index, int(p.grp)) for p in parts.itertuples()]
    placed = F.broadcast(asked.sparkSession.createDataFrame(where, "of bigint, nth bigint, at int, grp bigint"))
    members = index.members.join(placed, (F.col("part.pivot") == F.col("of")) & (F.col("part.nth") == F.col("nth")))
    # only queries of its own block of ids or a later one may see a vector
    members = members.select("id", "vec", "r", "at", "grp", F.explode(F.sequence(retrieval.block_of(ends), F.lit(len(ends)))).alias("qb"))
    pivot, low, high = (parts[c].to_numpy() for c in ("pivot", "low", "high"))

    def see(some: Nearest, rows: np.ndarray, m: dict, chosen: np.ndarray) -> None:
        for c in range(0, len(chosen), nearest.COLUMNS):
            own = chosen[c : c + nearest.COLUMNS]
            if count is not None:
                count.add(len(rows) * len(own))
            some.see(rows, m["vec"][own], m["id"][own])

    def compared(q: pa.Table, m: pa.Table, first: bool):
        """Nearest of at most nearest.ROWS queries each, when all that is theirs was seen."""
        q = q.append_column("near", pa.array(_to_pivots(nearest.matrix(q.column("vec")), pivots).argmin(axis=1), pa.int64()))
        q, m = _sorted(q, "home", "near", "id"), _sorted(m, "at", "id")
        numbers, starts = np.unique(m["at"], return_index=True)
        spans = dict(zip(numbers.tolist(), zip(starts, [*starts[1:], len(m["at"])], strict=True), strict=True))
        stops = np.flatnonzero(np.diff(q["home"])) + 1  # in the first pass a home at a time
        for low_q, high_q in zip([0, *stops], [*stops, len(q["id"])], strict=True):
            for at in range(low_q, high_q, nearest.ROWS):
                of = slice(at, min(at + nearest.ROWS, high_q))
                some = Nearest(q["vec"][of], q["id"][of], k, exclusion, q["bound"][of])
                far = _to_pivots(some.vectors, pivots)
                for p in [q["home"][at]] if first else numbers:
                    begin, end = spans[int(p)]
                    gap, reach = far[:, pivot[p]], _reach(some.bound)
                    margin = 1e-9 * (1 + gap + high[p])
                    rows = np.flatnonzero(np.maximum(gap - high[p], low[p] - gap) - margin <= reach)
                    if not len(rows):
                        continue
                    end = begin + np.searchsorted(m["id"][begin:end], some.ids[rows].max() - exclusion)
                    r = m["r"][begin:end]
                    reach = (reach + margin)[rows]
                    see(some, rows, m, begin + np.flatnonzero((r >= (gap[rows] - reach).min()) & (r <= (gap[rows] + reach).max())))
                yield some

    def bounds(q: pa.Table, m: pa.Table) -> pa.Table:
        found = [some.kth() for some in compared(q, m, True)] if len(q) and len(m) else []
        return pa.table({"id": np.concatenate([i for i, _ in found]), "bound": np.concatenate([d for _, d in found])}) if found else BOUND.empty_table()

    def best(q: pa.Table, m: pa.Table) -> pa.Table:
        return retrieval.as_found([some.found() for some in compared(q, m, False)] if len(q) and len(m) else [])

    def meet(rows: DataFrame, run, schema: str) -> DataFrame:
        return rows.groupBy("qb", "grp").cogroup(members.groupBy("qb", "grp")).applyInArrow(run, schema)

    blocked = asked.select("id", "vec", retrieval.block_of(ends).alias("qb"))
    nothing = F.lit(float("inf"))
    kth = meet(_asked(blocked.withColumn("bound", nothing), parts, pivots, exclusion, True), bounds, "id bigint, bound double")
    bounded = blocked.join(kth, "id", "left").select("id", "vec", "qb", F.coalesce("bound", nothing).alias("bound"))
    found = meet(_asked(bounded, parts, pivots, exclusion, False), best, "query_id bigint, cand_id bigint, d2 double")
    order = Window.partitionBy("query_id").orderBy("d2", "cand_id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
