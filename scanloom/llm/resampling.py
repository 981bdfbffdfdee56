"""Importance resampling towards a target, over a sparse count matrix (operator 12).

A text is lower-cased (A-Z), cut into words, and its features are all runs of one to
GRAM words, joined by a space; a feature's bucket is its CRC-32 modulo BUCKETS.

1. The document-by-bucket count matrix is written once, as blocks of compressed sparse
   rows (CSR) in the shared folder: ids, row pointers, buckets and counts.
2. Its column sums, added up in the tasks and then by bucket, are the distribution of
   the documents; those of the target texts come in the same way. Both have BUCKETS
   numbers at most, whatever the input's size, and give the gain of each bucket.
3. The product of the matrix and the gains, block by block, divided by a document's
   number of features, is its weight.
4. Weight plus Gumbel noise of the seed and the id is a score; the highest scores are a
   draw without replacement. They are numbered by ranges, not in one window.

Null texts count as empty. A document without features has weight 0; one with fewer than
least words is never drawn, but has its row. Ties of the score go to the smaller id, null
ids last, and of one id to the shorter text; a null id has the noise of an empty one. Every row counts, also those of equal
ids. An empty table gives no rows, empty targets a uniform distribution. Texts are read
whole, a megabyte at a time. Other columns are ignored, or returned by resample().
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..operators.ordering import numbered
from .common import documents, quoted, shuffled, small_batches, spool
from .ranking import CRC32

BUCKETS, GRAM = 10_000, 2
#: Numbers in a block, at which it is written; bytes of a text at a time; words whose
#: checksums a task remembers; texts and blocks that a task takes at a time.
BLOCK, PART, KNOWN, TEXTS, BLOCKS = 1 << 14, 1 << 20, 1 << 16, 512, 64
#: How a block holds buckets and counts.
NUMBER = np.dtype("<u4")
# Word characters are 0-9, a-z and all beyond ASCII; A-Z are folded.
_WORD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class _Checksums(dict):
    """CRC-32 of a word, followed by what end says."""

    def __init__(self, end: bytes):
        self.end = end

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = zlib.crc32(word + self.end)
        return found


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            cut = text.rfind(b" ", at, end) + 1
            end = cut or (text.find(b" ", end) + 1) or len(text)
        yield text[at:end].split()
        at = end


def count_buckets(text: str | None, buckets: int, alone: _Checksums, before: _Checksums) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, and the buckets that occur with their counts."""
    n_words, found, last = 0, [], []
    for words in _parts((text or "").encode().translate(_WORD)):
        n_words += len(words)
        pairs = last + words
        found.append(np.fromiter(map(alone.__getitem__, words), np.uint32, len(words)))
        if len(pairs) > 1:
            found.append(np.fromiter(map(zlib.crc32, pairs[1:], map(before.__getitem__, pairs[:-1])), np.uint32, len(pairs) - 1))
        last = words[-1:] or last
        if len(found) > 64:
            found = [np.concatenate(found)]
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint32)
    cols, counts = np.unique(hashes % np.uint32(buckets), return_counts=True)
    return n_words, len(hashes), cols.astype(np.int32), counts.astype(np.int64)


def csr_blocks(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text): the count matrix, a row for each block: doc_ids, n_words and
    n_features of its documents, ends (where each one's row ends), cols and counts, both
    as NUMBERs."""
    schema = StructType([
        StructField("doc_ids", ArrayType(docs.schema["doc_id"].dataType)),
        *[StructField(c, ArrayType(LongType())) for c in ("n_words", "n_features", "ends")],
        StructField("cols", BinaryType()), StructField("counts", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, before = _Checksums(b""), _Checksums(b" ")
        for batch in batches:
            start, held, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(count_buckets(text.as_py(), buckets, alone, before))
                size += len(held[-1][2]) + 1
                if size >= BLOCK or i + 1 == batch.num_rows:
                    ends = np.cumsum([len(h[2]) for h in held])
                    values = [batch.column(0).slice(start, len(held)), *(pa.array([h[k] for h in held], pa.int64()) for k in (0, 1)), pa.array(ends, pa.int64())]
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
                    lists += [pa.array([np.concatenate([h[k] for h in held]).astype(NUMBER).tobytes()], pa.binary()) for k in (2, 3)]
                    yield pa.RecordBatch.from_arrays(lists, schema.names)
                    start, held, size = i + 1, [], 0

    return docs.mapInArrow(run, schema)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cols, counts in zip(*batch.columns, strict=True):
                np.add.at(total, np.frombuffer(cols.as_buffer(), NUMBER), np.frombuffer(counts.as_buffer(), NUMBER))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    return blocks.select("cols", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(of_docs: DataFrame, of_targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the logarithm of how much more frequent a bucket is in the target,
    rounded down; each bucket counts once more than it occurs. At most buckets rows of
    either come to the driver."""

    def dense(sums: DataFrame) -> list[int]:
        out = [0] * buckets
        for bucket, n in sums.collect():
            out[bucket] = n
        return out

    s, t = dense(of_docs), dense(of_targets)
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s, t, strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """A row for each document: doc_id, n_words, n_features and weight, the product of
    its row and the gains over its features, rounded down."""
    schema = StructType([StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_words, n_features, ends = (c[i].values for c in batch.columns[:4])
                cols, counts = (np.frombuffer(c[i].as_buffer(), NUMBER) for c in batch.columns[4:])
                sums = np.concatenate([[0], np.cumsum(counts * gain[cols])])
                ends = np.concatenate([[0], ends.to_numpy()])
                weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n_features.to_numpy(), 1)
                yield pa.RecordBatch.from_arrays([ids, n_words, n_features, pa.array(weight)], schema.names)

    return blocks.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times Gumbel noise that follows from the seed and the id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("bigint") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def draw(docs: DataFrame, targets: DataFrame, percent: int, least: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs, and targets with a column of text_col: a row for each of docs with doc_id,
    n_words, n_features, weight, score and rank, from 1 for the percent of the documents
    of least words or more that are drawn, else null."""
    narrow = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    wanted = targets.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    with small_batches(docs.sparkSession, TEXTS):
        blocks, goal = (spool(csr_blocks(x, buckets), "csr", codec="zstd") for x in (narrow, wanted))
    with small_batches(docs.sparkSession, BLOCKS):
        gain = gains(column_sums(blocks, buckets), column_sums(goal, buckets), buckets)
        scored = spool(weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    may = scored.where(F.col("n_words") >= least)
    n = may.count() * percent // 100
    ranked = numbered(may, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_words"), F.col("n_features"), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, targets: DataFrame, percent: int, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of docs that are drawn; rows of one id go together, if any is drawn."""
    drawn = draw(docs, targets, percent, id_col=id_col, **more).where(F.col("rank").isNotNull())
    ids = drawn.select(F.col("doc_id").alias("drawn_id__")).distinct()
    return docs.join(shuffled(ids), docs[quoted(id_col)].eqNullSafe(F.col("drawn_id__")), "left_semi")


def op12_target_resampling(spark, sf_dir: str) -> DataFrame:
    targets = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return draw(documents(spark, sf_dir, "doc_id", "text"), targets, percent=25).select("doc_id", "n_features", "weight", "score", "rank")


_BYTES = "list_transform(range(1, octet_length(encode(f)) + 1), lambda i: CAST('0x' || substring(hex(encode(f)), 2 * i - 1, 2) AS BIGINT))"
_CRC = CRC32.replace("list_transform(range(1, len({0}) + 1), lambda i: ascii(substring({0}, i, 1)))", _BYTES)

ORACLE = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT side, id, f, count(*) AS n FROM grams GROUP BY ALL),
buckets AS (SELECT f, {_CRC} % 10000 AS b FROM (SELECT DISTINCT f FROM counted)),
cells AS (SELECT side, id, b, sum(n) AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM cells GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sums),
weighed AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight
  FROM cells JOIN gains USING (b) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (id) WHERE side = 'd'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN pos <= 25 * n // 100 THEN pos END AS rank
FROM scored s LEFT JOIN ranked r ON s.doc_id = r.doc_id"""
