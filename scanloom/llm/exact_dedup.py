"""Exact deduplication by two-pass Bloom filtering (operator 10, native).

Pass 1 marks Bloom cells that two or more rows set. Pass 2 probes them: a row
with an unmarked cell is certainly alone and passes straight through; only the
rest is shuffled, grouped by SHA-256 of the normalised text, and decided. A filter
has at most bloom.MAX_BITS; more rows are dealt into parts by a hash of the digest,
each with a filter of its own and in a folder of its own, so that a filter keeps its
16 bits a row whatever the number of rows.

Texts are equal when identical after lower-casing A-Z only; a null text counts as
empty. Of equal texts the row with the largest doc_id stays (null ids come last);
if that very id occurs more than once, one of those rows stays. Texts of any
length are hashed whole, an empty table gives an empty result, and input columns
beside the id and the text are ignored or, in keep_one(), returned as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, documents, join_groups, quoted, split_by_keys, spool, whole_row

PROBES = 3


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as binary."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def split_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Of each row doc_id, digest and rid, a number of the row: all that the decision
    needs. The rows that are certainly alone, the others, and the number of all."""
    n = docs.count()
    parts = max(1, -(-n * bloom.BITS_A_KEY // bloom.MAX_BITS))
    number = F.monotonically_increasing_id().alias("rid")
    keys = docs.select(F.col(quoted(id_col)).alias("doc_id"), digest(F.col(quoted(text_col))).alias("digest"), number)
    part = F.pmod(F.xxhash64(F.lit("part"), "digest"), F.lit(parts)).cast("int")
    keys = spool(keys.withColumn("part", part), "digests", "part") if parts > 1 else spool(keys.withColumn("part", F.lit(0)), "digests")
    pages, found = bloom.pages_for(-(-n // parts)), []
    for i in range(parts):
        own = keys.where(F.col("part") == i).drop("part")
        repeated = spool(bloom.build_repeated(own, "digest", pages, PROBES), "repeated")
        maybe = bloom.maybe(repeated.scalar(), F.col("digest"), pages, PROBES)
        sides = (own.where(~maybe), own.where(maybe))
        # One filter a plan: a part is written before the next one's filter is read.
        found.append(sides if parts == 1 else tuple(spool(side, "split") for side in sides))
    alone, shared = (reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
    return alone, shared, n


def find_groups(shared: DataFrame) -> DataFrame:
    """shared(doc_id, rid, digest): groups(digest, keep (doc_id, rid), group_size,
    tied). tied: the largest doc_id occurs more than once."""
    per_id = (
        shared.groupBy("digest", "doc_id")
        .agg(F.max("rid").alias("rid"), F.count("*").alias("n"))
    )
    groups = per_id.groupBy("digest").agg(
        F.max(F.struct(F.col("doc_id"), F.col("rid"))).alias("keep"),
        F.sum("n").alias("group_size"),
        F.max_by("n", F.struct("doc_id", "rid")).alias("of_keep"),
    )
    groups = groups.select("digest", "keep", "group_size", (F.col("of_keep") > 1).alias("tied"))
    return spool(groups, "groups")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    alone, shared, n = split_keys(docs, id_col, text_col)
    groups = find_groups(shared)
    alone = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    shared = join_groups(shared, groups, "digest", n).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "digest"
    )
    return alone.unionByName(shared).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns. Texts are hashed once, for
    the keys; after that a Bloom filter of the ids that may have to go lets all other
    rows pass, and only the rest is hashed again and shuffled."""
    _, shared, n = split_keys(docs, id_col, text_col)
    groups = find_groups(shared)
    members = join_groups(shared, groups.where("group_size > 1"), "digest", n, many=True)
    going = spool(members.where(F.col("tied") | (F.col("rid") != F.col("keep.rid"))).select("doc_id").distinct(), "going")
    stay, asked = split_by_keys(docs, id_col, going, "doc_id")
    packed = asked.select(digest(F.col(quoted(text_col))).alias("digest"), whole_row(docs).alias("row"))
    best = join_groups(packed, groups, "digest", n, "left", many=True).where(F.col("keep").isNull() | F.col("row")[id_col].eqNullSafe(F.col("keep.doc_id")))
    tied = F.coalesce(F.col("tied"), F.lit(False))
    once = best.where(~tied).unionByName(best.where(tied).dropDuplicates(["digest"]))
    return stay.unionByName(once.select("row.*"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_report(documents(spark, sf_dir, "doc_id", "text"))


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t"""
