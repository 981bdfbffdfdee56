"""SimHash near-duplicates through segment popcounts (operator 6).

A fingerprint has 64 bits; bit i is 1 if it is set in over half the XXH64 hashes of
the text's word shingles. The fingerprint is cut into 32 segments of two bits, and
a segment is mapped to its number of ones. The Manhattan distance of two such
vectors is at most the Hamming distance of the fingerprints, so fingerprints within
MAX_BITS differ by at most MAX_BITS there: of the two halves of the vector one
differs by MAX_BITS // 2 = 1 at most. Fingerprints meet in grid cells: each half
puts one row into its own cell, and one row into every cell within distance 1 of
it, so that exactly the pairs within that distance in a half meet. The join checks
the Hamming distance itself; only true links leave it. From MANY fingerprints on the
segments are of one bit: a third more rows are exchanged, but unrelated fingerprints
meet in 1.5e-8 of all pairs in place of 9e-6.

Equal fingerprints are one node of the graph, so a group of copies of any size
costs one row; membership comes back by a join on the fingerprint. Links are
between different fingerprints, and components are the transitive closure.

A null or empty text has fingerprint zero, linked like any other. A text with
fewer words than a shingle is one shingle. Texts are read whole. Null ids are
never representatives unless a component has no other; repeated ids and rows are
members like others. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, documents_kept, join_groups, least_of_components, quoted, shuffled, spool
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints from which on segments have one bit.
MANY = 1 << 22
#: Shingles that are hashed at a time; very long texts go through in parts.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        grams = zip(*(words[at + k : at + k + size] for k in range(shingle)), strict=True)
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in map(b" ".join, grams)), dtype=np.uint64, count=size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(docs[quoted(id_col)].alias("doc_id"), docs[quoted(text_col)].alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, fp bigint")


def _halves(fp: Column, width: int) -> Column:
    """The popcounts of the segments of each half, as fields of the segments' width."""
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)

    def count(half: Column) -> Column:
        return half if width == 1 else half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))

    return F.array(F.struct(F.lit(0).alias("half"), count(low).alias("cell")), F.struct(F.lit(1).alias("half"), count(high).alias("cell")))


def _cells_around(cell: Column, width: int) -> Column:
    """The cell itself and those within Manhattan distance 1."""

    def step(k: Column) -> Column:
        unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), width * k)
        field = F.call_function("shiftright", cell, width * k).bitwiseAND((1 << width) - 1)
        return F.array(F.when(field < width, cell + unit), F.when(field > 0, cell - unit))

    around = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32 // width - 1)), step))
    return F.concat(F.array(cell), F.filter(around, lambda c: c.isNotNull()))


def links(nodes: DataFrame, width: int | None = None) -> DataFrame:
    """nodes(fp): the pairs (a, b), a < b, of different fingerprints that differ in
    at most MAX_BITS bits. A pair may come more than once. width: bits of a segment, 1
    or 2; the result is the same for both."""
    if width is None:
        width = 2 if nodes.count() < MANY else 1
    near = nodes.select("fp", F.explode(_halves(F.col("fp"), width)).alias("h")).select("fp", "h.half", "h.cell")
    left = near.select(F.col("fp").alias("a"), "half", "cell")
    right = near.select(F.col("fp").alias("b"), "half", F.explode(_cells_around(F.col("cell"), width)).alias("cell"))
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    # Spark takes the exploded cells for as few as the nodes, and would broadcast them
    pairs = left.join(shuffled(right), ["half", "cell"]).where((F.col("a") < F.col("b")) & within)
    return pairs.select("a", "b")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and fp, group_size, n_links, component_id and
    keep_fp of each."""
    prints = spool(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "nodes")
    found = spool(links(nodes.select("fp")).distinct(), "pairs")
    roots = components(found)
    ends = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    classes = (
        nodes.join(shuffled(ends), "fp", "left")
        .join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left")
        .withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("bigint"), "root": F.coalesce("root", "fp")})
    )
    return prints, spool(least_of_components(classes), "classes")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, n_links (other fingerprints linked to its
    own) and component_id, the least id of its component."""
    prints, classes = _classes(docs, id_col, text_col, shingle)
    return join_groups(prints, classes, "fp", prints.count(), many=True).select("doc_id", "fp", "n_links", "component_id")


def _signed(text: str | None) -> int:
    return int(np.uint64(fingerprint(text)).view(np.int64))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component one with the least id."""
    prints, classes = _classes(docs, id_col, text_col, SHINGLE)
    return documents_kept(docs, id_col, text_col, prints, classes, _signed)


def op6_simhash_groups(spark, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir, "doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id", "n_links")


#: DuckDB has no XXH64; the query is tested against a brute-force version.
ORACLE = None
