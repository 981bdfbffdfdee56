"""Bloom filters out of DataFrame functions alone.

A filter is one row with an array of bitmaps ("pages") of 32,768 bits, built by
bitmap_construct_agg: page by page in parallel, with partial aggregation. Probes
read it as a scalar subquery, so no row is shuffled or joined. Its size is fixed
before it is built: BITS_A_KEY bits for each key, up to MAX_BITS (16 MB). Beyond
that size it answers "maybe" more often; it never answers "no" wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 32768
BITS_A_KEY = 16
MAX_BITS = 1 << 27


def pages_for(n_keys: int, bits_a_key: float = BITS_A_KEY) -> int:
    """Pages of a filter for so many keys, a power of two."""
    pages = 1
    while pages * PAGE_BITS < n_keys * bits_a_key and pages * PAGE_BITS < MAX_BITS:
        pages *= 2
    return pages


def positions(key: Column, pages: int, k: int, salt: int = 0) -> list[Column]:
    """The k bit positions of a key of any type that xxhash64 takes."""
    return [F.pmod(F.xxhash64(F.lit(1000 * salt + i), key), F.lit(pages * PAGE_BITS)) for i in range(k)]


def build(cells: DataFrame, pages: int) -> DataFrame:
    """cells: a column pos of bit positions. One row: pages array<binary>."""
    empty = cells.sparkSession.range(pages).select((F.col("id") * PAGE_BITS).alias("pos"), F.lit(False).alias("real"))
    return (
        cells.select("pos", F.lit(True).alias("real"))
        .unionByName(empty)
        .groupBy(F.shiftright("pos", 15).alias("page"))
        .agg(F.bitmap_construct_agg(F.when(F.col("real"), F.col("pos").bitwiseAND(PAGE_BITS - 1))).alias("bits"))
        .agg(F.array_sort(F.collect_list(F.struct("page", "bits"))).alias("pages"))
        .select(F.transform("pages", lambda p: p["bits"]).alias("pages"))
    )


def build_from_keys(keys: DataFrame, key: str, pages: int, k: int, salt: int = 0) -> DataFrame:
    return build(keys.select(F.explode(F.array(*positions(F.col(key), pages, k, salt))).alias("pos")), pages)


def build_repeated(keys: DataFrame, key: str, pages: int, k: int) -> DataFrame:
    """A filter of the cells that two or more rows set. A key of two rows has all
    its cells set; most other keys miss one."""
    cells = keys.select(F.explode(F.array(*positions(F.col(key), pages, k))).alias("pos"))
    return build(cells.groupBy("pos").agg(F.count("*").alias("n")).where("n > 1").select("pos"), pages)


def _bit(filter_pages: Column, pos: Column) -> Column:
    page = F.get(filter_pages, F.shiftright(pos, 15).cast("int"))
    byte = F.substring(page, F.shiftright(pos.bitwiseAND(PAGE_BITS - 1), 3).cast("int") + 1, F.lit(1))
    return F.call_function("getbit", F.conv(F.hex(byte), 16, 10).cast("bigint"), pos.bitwiseAND(7).cast("int")) == 1


def maybe(filter_pages: Column, key: Column, pages: int, k: int, salt: int = 0) -> Column:
    """Whether the filter may hold the key; false is certain."""
    found = F.lit(True)
    for pos in positions(key, pages, k, salt):
        found = found & _bit(filter_pages, pos)
    return found


#: Bits of a window: six bytes, so that its number is a positive bigint.
WINDOW_BITS = 48


def _window(key: Column, pages: int) -> tuple[Column, Column, list[Column]]:
    """The page and first byte of a key's window, and its four bits, 0 the lowest of the last byte."""
    place, bits = (F.xxhash64(F.lit(2000 + i), key) for i in (0, 1))
    first = F.pmod(F.shiftright(place, 32), F.lit((PAGE_BITS - WINDOW_BITS) // 8 + 1)).cast("int")
    return F.pmod(place, F.lit(pages)).cast("int"), first, [F.pmod(F.shiftright(bits, 16 * i), F.lit(WINDOW_BITS)).cast("int") for i in range(4)]


def build_windows(keys: DataFrame, key: str, pages: int) -> DataFrame:
    """A filter in which a key sets bits of one window only, so that a probe names the
    filter once: what a plan's tasks are sent holds the pages once for each time."""
    page, first, bits = _window(F.col(key), pages)
    start = page.cast("bigint") * PAGE_BITS + 8 * first + WINDOW_BITS - 8
    return build(keys.select(F.explode(F.array(*(start - 8 * F.floor(b / 8) + b % 8 for b in bits))).alias("pos")), pages)


def maybe_window(filter_pages: Column, key: Column, pages: int) -> Column:
    """Whether a filter of build_windows() may hold the key; false is certain."""
    page, first, bits = _window(key, pages)
    word = F.conv(F.hex(F.substring(F.get(filter_pages, page), first + 1, F.lit(WINDOW_BITS // 8))), 16, 10).cast("bigint")
    mask = F.lit(0).cast("bigint")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))
    return F.bitwise_not(word).bitwiseAND(mask) == 0
