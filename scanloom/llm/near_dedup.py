"""Near-duplicate documents: SimHash candidates, verified by the Jaccard similarity of
word shingles (operator 6 as the pipeline uses it).

Two documents are linked if their sets of five-word shingles (A-Z lower-cased, ASCII
white space) have a Jaccard similarity of at least 4/5; a group is the transitive
closure of the links. The result is exact, up to collisions of 64-bit hashes.

1. Fingerprints of the sets within three bits, from the segment-popcount join of
   simhash_dedup, are candidates. At a similarity of 4/5 fingerprints differ in ten
   bits or so, hence the other candidates:
2. Prefixes. In any fixed order of all shingles, linked sets of n shingles share one of
   their first n - ceil(4n/5) + 1. Shingles that a sample of documents repeats come last
   in the order, which changes the cost, not the result. Of documents that meet in a
   prefix each is compared to one of them, another for each shingle.
3. Once these candidates are verified and their components known, documents of
   different components that meet in a prefix are compared to each other. A shingle's
   members are told apart by size first, as sizes must be alike, and only groups of more
   than one component go on: a large group of near copies is one component by then, and
   none of its members is exchanged again. Members of a group go into blocks of BLOCK, a
   task gets two blocks at most, and in it only pairs of different components are formed.

A pair is dropped early if its sizes, or the places of the shared shingle, rule a
similarity of 4/5 out, or by counts of shingles by hash modulo COARSE or CELLS: their
Manhattan distance is at most the size of the sets' symmetric difference. What is left
is decided on the whole sets.

Equal sets are one node of the graph. A text with fewer words than a shingle is one
shingle, and one without words has none; those are equal to each other. Null ids are
representatives only where there is no other id. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import documents_kept, join_groups, least_of_components, quoted, shuffled, small_batches, split_by_keys, spool
from .components import components
from .language_model import token_hashes

SHINGLE = 5
CELLS, COARSE = 256, 32
#: Documents of a shared shingle that are compared in one task, and pairs at a time.
BLOCK, PAIRS = 1024, 1 << 19
#: Pairs whose cells are compared at a time.
PART = 1 << 14
#: Documents whose shingles are counted to find the common ones, and how many are kept.
SAMPLE, COMMON = 5000, 1 << 18
#: Sizes are alike if they differ by less than this factor; above 5/4.
ALIKE = 1.3
#: Texts that a task takes at a time.
TEXTS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = token_hashes([(text or "").encode()])[0][:-1]
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = (out ^ words[k : k + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def key_of(found: np.ndarray) -> int:
    """A number of the set, signed."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes())).view(np.int64))


def text_key(text: str | None) -> int:
    return key_of(shingles(text))


def _common(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts repeats, sorted, and their ranks from 1,
    by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n_docs // SAMPLE))) == 0).select("text")
    counts = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, signed."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), simhash_dedup.BLOCK):
        part = found[at : at + simhash_dedup.BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def _counts(found: np.ndarray, cells: int) -> bytes:
    """Shingles by hash modulo cells, up to 255 each."""
    return np.minimum(np.bincount((found % np.uint64(cells)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _prints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): doc_id, fp (the set's key), sim (its fingerprint), n, counts
    by cell, and the prefix."""
    common, ranks = _common(docs, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py()) for text in batch.column(1)]
            prefixes = []
            for found in sets:
                n, ordered = len(found), found
                if n and len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    rank = np.where(common[at] == found, ranks[at], 0)
                    ordered = found[np.argsort(rank, kind="stable")]
                prefixes.append(ordered[: n - (4 * n + 4) // 5 + 1].view(np.int64) if n else ordered.view(np.int64))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32))
            columns = {
                "doc_id": batch.column(0),
                "fp": pa.array(map(key_of, sets), pa.int64()),
                "sim": pa.array(map(fingerprint, sets), pa.int64()),
                "n": pa.array(map(len, sets), pa.int64()),
                "cells": pa.array([_counts(x, CELLS) for x in sets], pa.binary()),
                "coarse": pa.array([_counts(x, COARSE) for x in sets], pa.binary()),
                "prefix": pa.ListArray.from_arrays(ends, flat),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint, sim bigint, n bigint, cells binary, coarse binary, prefix array<bigint>"
    return docs.mapInArrow(run, schema)


def _may_link(x: Column, y: Column) -> Column:
    """Whether the sizes and the places of a shared shingle allow a link; exact for the
    first shingle that the sets share."""
    both = 4 * (x["n"] + y["n"])
    left = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return (5 * F.least(x["n"], y["n"]) >= 4 * F.greatest(x["n"], y["n"])) & (9 * left >= both)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of equal width as rows of small numbers."""
    return np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8).reshape(-1, width).astype(np.int16)


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.least(x["fp"], y["fp"]).alias("a"), F.greatest(x["fp"], y["fp"]).alias("b")]


def _not_far(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, n, x, y), n the number of shingles of both, those whose counts
    by cell, x and y, allow a link."""
    for batch in batches:
        x, y = (_matrix(batch.column(i), cells) for i in (3, 4))
        apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(9 * apart <= batch.column(2).to_numpy()))


def _cells_allow(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that CELLS counts leave."""
    of_a = nodes.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("cells").alias("x"))
    of_b = nodes.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("cells").alias("y"))
    both = pairs.join(shuffled(of_a), "a").join(shuffled(of_b), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "x", "y")
    return both.mapInArrow(lambda batches: _not_far(batches, CELLS), "a bigint, b bigint")


def _verified(left: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of left(a, b) that are links; left is read several times."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["fp", "hashes"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                keep.append(9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # one document of each set, told by its id; only those are cut into shingles again
    ends = left.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    ids = spool(nodes.select("fp", "first_id").join(shuffled(ends), "fp"), "ends")
    asked = split_by_keys(docs, "doc_id", ids, "first_id")[1].select("text").mapInArrow(sets, "fp bigint, hashes binary")
    whole = spool(asked.join(shuffled(ids.select("fp")), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    whole_a, whole_b = (whole.select(F.col("fp").alias(k), F.col("hashes").alias(v)) for k, v in (("a", "p"), ("b", "q")))
    return spool(left.join(shuffled(whole_a), "a").join(shuffled(whole_b), "b").select("a", "b", "p", "q").mapInArrow(linked, "a bigint, b bigint"), "near-links")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that operator 6 finds: each set with one of its fingerprint, and
    those of fingerprints within its bits."""
    ones = spool(nodes.groupBy("sim").agg(F.min("fp").alias("one")), "sims")
    same = nodes.select("fp", "sim").join(shuffled(ones), "sim").where("fp <> one").select(F.col("one").alias("a"), F.col("fp").alias("b"))
    found = simhash_dedup.links(ones.select(F.col("sim").alias("fp")))
    a, b = (ones.select(F.col("sim").alias(k), F.col("one").alias(f"one_{k}")) for k in "ab")
    near = found.join(shuffled(a), "a").join(shuffled(b), "b")
    return same.unionByName(near.select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b")))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by token, low and high, cut between groups."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        starts = _group_starts(rows)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1])
        kept = rows.slice(starts[-1]).combine_chunks()
    if kept is not None:
        yield kept


def _group_starts(rows: pa.Table) -> np.ndarray:
    token, low, high = (rows[k].to_numpy() for k in ("token", "low", "high"))
    new = (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each pair occurs first in sorted order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def _within_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of shared shingles, sorted by group: the pairs of different components
    that sizes, places and counts by cell leave. Holds a group and a batch at a time."""
    found, n_found = [], 0

    def told() -> pa.RecordBatch:
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        once = _distinct(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

    for rows in _whole_groups(batches):
        token, low, high, root = (rows[k].to_numpy() for k in ("token", "low", "high", "root"))
        rows = rows.take(pa.array(np.lexsort((root, high, low, token)))).combine_chunks()
        n, pos, fp, root, block, low, high, upper = (rows[k].to_numpy() for k in ("n", "pos", "fp", "root", "block", "low", "high", "upper"))
        starts, cells = _group_starts(rows), _matrix(rows["cells"], CELLS)
        within = low == high
        # partners of a member: those of its group behind its own component
        runs = np.union1d(starts, np.flatnonzero(root[1:] != root[:-1]) + 1)
        run_end, group_end = (np.repeat(np.append(x[1:], len(n)), np.diff(x, append=len(n))) for x in (runs, starts))
        later = group_end - run_end
        at = 0
        while at < len(n):
            upto = np.cumsum(later[at : at + BLOCK])
            end = at + max(1, int(np.searchsorted(upto, PAIRS, "right")))
            count = later[at:end]
            x = np.repeat(np.arange(at, at + len(count)), count)
            y = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + run_end[x]
            ok = upper[x] | upper[y]
            ok &= within[x] | (block[x] != block[y])
            x, y = x[ok], y[ok]
            both = n[x] + n[y]
            ok = (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])) & (9 * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= 4 * both)
            x, y, both = x[ok], y[ok], both[ok]
            a, b = np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])
            first = _distinct(a, b)  # a pair once, however many shingles it shares
            x, y, both, a, b = (v[first] for v in (x, y, both, a, b))
            near = np.concatenate([9 * np.abs(cells[x[i : i + PART]] - cells[y[i : i + PART]]).sum(axis=1, dtype=np.int64) <= both[i : i + PART] for i in range(0, len(x), PART)] or [x > 0])
            if near.any():
                found.append((a[near], b[near]))
                n_found += len(found[-1][0])
            if n_found > PAIRS:
                yield told()
                found, n_found = [], 0
            at = end
    if found:
        yield told()


def open_members(met: DataFrame, known: DataFrame, n_met: int) -> DataFrame:
    """met(token, fp, n, pos), known(fp, root): the members (token, fp, n, pos, upper,
    group_size) of shared shingles and sizes alike that belong to more than one component.
    A member is in the group of its size and, not upper, in the next one's; token: of both."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ALIKE))).cast("int")
    sides = F.explode(F.array(F.struct(step.alias("size"), F.lit(True).alias("upper")), F.struct((step + 1).alias("size"), F.lit(False).alias("upper"))))
    sized = met.select("token", "fp", "n", "pos", sides.alias("s")).select(F.xxhash64("token", "s.size").alias("token"), "fp", "n", "pos", "s.upper")
    rooted = sized.select("token", "fp").join(shuffled(known.select("fp", "root")), "fp")
    groups = rooted.groupBy("token").agg(F.count("*").alias("group_size"), F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = spool(groups.where("least < most").select("token", "group_size"), "mixed")
    # written, as its filter would go to the tasks of both sides of the join
    asked = spool(split_by_keys(sized, "token", mixed, "token")[1], "open")
    return join_groups(asked, mixed, "token", 2 * n_met, many=True)


def links(prints: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different sets, enough to join all that are connected."""
    entries = prints.select("fp", "n", "coarse", F.posexplode("prefix").alias("pos", "token"))
    shared = spool(entries.groupBy("token").agg(F.count("*").alias("group_size")).where("group_size > 1"), "shared")
    met = spool(split_by_keys(entries, "token", shared, "token")[1], "met")
    n_met = met.count()
    # a hub of its own for each shingle, so that a document meets several others of its group
    member = F.struct("n", "pos", "fp", "coarse")
    hubs = met.groupBy("token").agg(F.min_by(member, F.struct(F.xxhash64("fp", "token"), "fp")).alias("x"), F.count("*").alias("group_size"))
    both = join_groups(met, hubs.where("group_size > 1"), "token", n_met, many=True).where(F.col("x.fp") != F.col("fp")).withColumn("y", member)
    both = both.where(_may_link(F.col("x"), F.col("y")))
    both = both.select(*_pairs(F.col("x"), F.col("y")), (F.col("x.n") + F.col("y.n")).alias("n"), F.col("x.coarse").alias("x"), F.col("y.coarse").alias("y"))
    first = both.mapInArrow(lambda batches: _not_far(batches, COARSE), "a bigint, b bigint")
    first = spool(first.unionByName(_by_fingerprint(nodes)).distinct(), "pairs")
    found = _verified(spool(_cells_allow(first, nodes), "close"), nodes, docs)

    roots = components(found).withColumnRenamed("node", "fp")
    known = spool(nodes.select("fp", "cells").join(shuffled(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "known")
    each = open_members(met, known, n_met).join(shuffled(known), "fp")
    blocks = F.ceil(F.col("group_size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    each = each.withColumns({"block": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    each = each.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    # rows, not lists of them, go to the tasks, which hold a batch and a group at a time
    each = each.select("token", "low", "high", "n", "pos", "fp", "root", "block", "upper", "cells")
    sorted_ = each.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    rest = sorted_.mapInArrow(_within_groups, "a bigint, b bigint").distinct()
    more = spool(rest.join(shuffled(first), ["a", "b"], "left_anti"), "pairs")
    return spool(found.unionByName(_verified(more, nodes, docs)), "links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group one with the least id."""
    with small_batches(docs.sparkSession, TEXTS):
        prints, classes = _classes(docs.select(docs[quoted(id_col)].alias("doc_id"), docs[quoted(text_col)].alias("text")))
    return documents_kept(docs, id_col, text_col, prints.select("doc_id", "fp"), classes, text_key)


def _classes(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """narrow(doc_id, text): the prints of all rows, and the classes of their sets."""
    prints = spool(_prints(narrow), "prints")
    firsts = [F.first(c).alias(c) for c in ("sim", "n", "cells", "coarse")]
    nodes = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size"), *firsts), "nodes")
    once = prints.select("fp", "n", "coarse", "prefix").dropDuplicates(["fp"])
    roots = components(links(once, nodes, narrow))
    classes = nodes.select("fp", "first_id", "group_size").join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left")
    return prints, spool(least_of_components(classes.withColumn("root", F.coalesce("root", "fp"))), "classes")
