"""Places within groups, ties included, by distributed multi-select (operator 11).

Lines are ranked within groups by a pair of numbers (first: larger is better; second:
smaller is better; nulls before all, equal to each other), and within equal pairs by
further columns (ascending, nulls last).

1. Count. One aggregation with map-side combine counts the lines of each group and
   pair. Pairs are encoded as two numbers whose order is the order of places.
2. Select. For all groups at once the pair that holds place k is found by binary search
   over the encoded space: a pass counts exactly the lines up to each group's middle and
   keeps the half with place k. Only rows in that half are read by the next pass, so all
   passes together read about twice the counts. First numbers are halved before second
   ones; the ends of a half are those that occur.
3. Sort. Lines up to their group's pair are all that can have a place up to k. They are
   dealt into ranges of (group, pair, further columns), so a group with many ties spans
   many tasks, and running counts give their places.

Groups of over 1/1000 of all lines are joined by broadcast (there are fewer than 1000),
the others by a shuffle; lines that are equal in all columns are counted before they are
sorted. Nothing that grows with the input goes to one task or to the driver.

A null in a group column is a value like others. Equal lines have places of their own.
An empty table gives no rows; k below 1 as well. Other columns are not carried: give an
id among the ties to join them back. first must be below 2^63 - 1 and second above -2^63,
the codes of null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sums
from .common import join_groups, quoted, shuffled, spool

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _upto(a: Column, b: Column) -> Column:
    """Whether a row's pair (a, b) is at most this one."""
    return (F.col("a") < a) | ((F.col("a") == a) & (F.col("b") <= b))


def _middle(low: str, high: str) -> Column:
    """The mean of two numbers, rounded down, without their sum."""
    return F.col(low).bitwiseAND(F.col(high)) + F.shiftright(F.col(low).bitwiseXOR(F.col(high)), 1)


def _box(when: Column | None = None, name: str = "") -> list[Column]:
    """The least and largest codes of the rows for which when holds."""
    of = lambda c: F.col(c) if when is None else F.when(when, F.col(c))
    return [f(of(c)).alias(f"{name}{c}{i}") for c in "ab" for i, f in enumerate((F.min, F.max))]


def cuts(counts: DataFrame, k: int) -> DataFrame:
    """counts(g, a, b, n): for each group g the pair (cut_a, cut_b) that holds line k, or
    one that no line of a smaller group is beyond, and group_size, its lines."""
    state = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), *_box())
    state = spool(state.withColumns({"lines": F.col("total"), "need": F.lit(k).cast("bigint"), "low": F.lit(None).cast("boolean"), "ma": F.lit(0).cast("bigint"), "mb": F.lit(0).cast("bigint")}), "select")
    active, done = counts.withColumns({"ma": F.lit(0).cast("bigint"), "mb": F.lit(0).cast("bigint")}), []
    point = (F.col("a0") == F.col("a1")) & (F.col("b0") == F.col("b1"))
    ends = (F.col("need") >= F.col("total")) | point
    while True:
        last = F.when(F.col("a0") == F.col("a1"), F.col("b1")).otherwise(F.lit(MOST))
        done.append(state.where(ends).select("g", F.col("a1").alias("cut_a"), last.alias("cut_b"), F.col("lines").alias("group_size")))
        going = state.where(~ends)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        wide = F.col("a0") < F.col("a1")
        new = going.select(
            "g", "need", "lines", "low",
            F.when(wide, _middle("a0", "a1")).otherwise(F.col("a0")).alias("new_a"),
            F.when(wide, F.lit(MOST)).otherwise(_middle("b0", "b1")).alias("new_b"),
        )
        # written as it is joined, so that Spark may split the partition of a large group
        met = active.join(shuffled(new), "g").where(F.col("low").isNull() | (_upto(F.col("ma"), F.col("mb")) == F.col("low")))
        active = spool(met.select("g", "a", "b", "n", "need", "lines", F.col("new_a").alias("ma"), F.col("new_b").alias("mb")), "active")
        state, active = spool(_counted(active), "select"), active.drop("need", "lines")


def _counted(active: DataFrame) -> DataFrame:
    """One exact count pass: how many lines are up to each group's middle, and what is
    known of the half that holds the line searched for."""
    below = _upto(F.col("ma"), F.col("mb"))
    kept = [F.min(c).alias(c) for c in ("need", "lines", "ma", "mb")]
    counted = active.groupBy("g").agg(
        *kept,
        F.sum("n").alias("n"), F.sum(F.when(below, F.col("n")).otherwise(0)).alias("n_low"),
        F.count("*").alias("rows"), F.count_if(below).alias("rows_low"),
        *_box(below, "l_"), *_box(~below, "h_"),
    )
    low = F.col("n_low") >= F.col("need")
    side = lambda x, y: F.when(low, x).otherwise(y)
    return counted.select(
        "g", "lines", "ma", "mb", low.alias("low"),
        side(F.col("need"), F.col("need") - F.col("n_low")).alias("need"),
        side(F.col("n_low"), F.col("n") - F.col("n_low")).alias("total"),
        side(F.col("rows_low"), F.col("rows") - F.col("rows_low")).alias("rows"),
        *[side(F.col(f"l_{c}{i}"), F.col(f"h_{c}{i}")).alias(f"{c}{i}") for c in "ab" for i in (0, 1)],
    )


def first_places(rows: DataFrame, groups: list[str], first: str, second: str, ties: list[str], k: int) -> DataFrame:
    """The lines of place 1 to k of each group: groups, first, second, ties, pos and
    tied, the number of lines of the group with this pair."""
    given = lambda c, new: F.col(quoted(c)).alias(new)
    more = [f"t{i}" for i in range(len(ties))]
    a = F.coalesce(F.bitwise_not(F.col(quoted(first)).cast("bigint")), F.lit(LEAST))
    b = F.coalesce(F.col(quoted(second)).cast("bigint"), F.lit(LEAST))
    group = F.struct(*[given(c, f"g{i}") for i, c in enumerate(groups)], F.lit(0).alias("all"))
    keyed = rows.select(group.alias("g"), a.alias("a"), b.alias("b"), *map(given, ties, more))
    counts = spool(keyed.groupBy("g", "a", "b").agg(F.count("*").alias("n")), "counts")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = spool(cuts(counts.where(F.lit(k > 0)), k), "cuts")
    kept = spool(join_groups(keyed, found, "g", n).where(_upto(F.col("cut_a"), F.col("cut_b"))).select("g", "a", "b", *more), "kept")
    once = spool(kept.groupBy("g", "a", "b", *more).agg(F.count("*").alias("n")), "lines")
    order = [F.col("g"), F.col("a"), F.col("b"), *[F.col(c).asc_nulls_last() for c in more]]
    upto = running_sums(once, order, {"upto": "n"}, group="g").where(F.col("upto") - F.col("n") < k)
    placed = upto.withColumn("pos", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.least("upto", F.lit(k)))))
    tied = kept.groupBy("g", "a", "b").agg(F.count("*").alias("tied"))
    return placed.join(tied, ["g", "a", "b"]).select(
        *[F.col(f"g.g{i}").alias(c) for i, c in enumerate(groups)],
        F.when(F.col("a") != LEAST, F.bitwise_not("a")).alias(first), F.when(F.col("b") != LEAST, F.col("b")).alias(second),
        *[F.col(new).alias(c) for c, new in zip(ties, more, strict=True)], "pos", "tied",
    )


#: Fixed values of the query: the parts of items, which sales are one group, the last place.
PARTS, SPECIAL, PLACES = 5, 5, 2


def op11_tied_places(spark, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    special = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % SPECIAL == 0, F.lit(False))
    one = lambda c: F.when(special, F.lit(-1)).otherwise(c).cast("bigint")
    rows = lines.select(
        one(F.col("vendor_id")).alias("vendor_id"),
        one(F.coalesce(F.col("item_id") % PARTS, F.lit(-1))).alias("part"),
        one(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).alias("tens"),
        F.floor(100 * F.col("discount") + 0.5).alias("percent"),
        *[F.col(c).cast("bigint").alias(c) for c in ("sale_id", "line_no", "quantity")],
        F.floor(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )
    found = first_places(rows, ["vendor_id", "part", "month"], "tens", "percent", ["sale_id", "line_no", "quantity", "amount_cents"], PLACES)
    return found.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: A step of a CRC-32 takes a byte in, or, for -1, moves one bit on.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(list_transform(range(1, len({0}) + 1), lambda i: ascii(substring({0}, i, 1))),
      lambda c: [c::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295)"""

ORACLE = f"""
WITH ids AS (
  SELECT sale_id, {CRC32.format("CAST(sale_id AS VARCHAR)")} % 5 = 0 AS special
  FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL)),
lines AS (
  SELECT l.*, coalesce(i.special, false) AS special, CAST(floor(quantity / 10) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent,
    CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
  FROM sale_lines l LEFT JOIN ids i ON l.sale_id = i.sale_id),
grouped AS (
  SELECT CAST(CASE WHEN special THEN -1 ELSE vendor_id END AS BIGINT) AS vendor_id,
    CAST(CASE WHEN special THEN -1 ELSE coalesce(item_id % 5, -1) END AS BIGINT) AS part,
    CAST(CASE WHEN special THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS BIGINT) AS month,
    tens, percent, CAST(sale_id AS BIGINT) AS sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, amount_cents
  FROM lines),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST,
      sale_id ASC NULLS LAST, line_no ASC NULLS LAST, quantity ASC NULLS LAST, amount_cents ASC NULLS LAST) AS pos,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
  FROM grouped)
SELECT vendor_id, part, month, CAST(pos AS BIGINT) AS pos, CAST(pos AS BIGINT) AS place, sale_id, line_no, quantity, percent, amount_cents, CAST(tied AS BIGINT) AS tied
FROM ranked WHERE pos <= 2"""
