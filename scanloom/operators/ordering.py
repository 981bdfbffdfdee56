"""Ranks, running sums and neighbours in the order of a whole table.

A window over all rows would run in one task. Here rows are dealt into ranges of the
order and sorted in each; what a range needs of those before it is one row of totals,
so only as many rows as there are ranges ever meet in one task. Rows that the order
ties are told apart by nothing: give it a unique last column where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import cut

AT, PART = "__at", "__part"


def ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df in ranges of the order, with the number of the range as PART."""
    return cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def numbered(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """df with each row's place in the order, from 1."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id()))
    part, within = F.shiftright(AT, 33), F.col(AT).bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias(PART)).agg(F.count("*").alias("n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select(PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn(PART, part).join(F.broadcast(starts), PART)
    return placed.withColumn(name, F.col("start") + within + 1).drop(AT, PART, "start")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """df with sums of columns over the rows up to and with each row: sums maps new
    names to columns. group: a column, the first of the order, at whose values sums start
    again; a group may span many ranges."""
    rows = ranges(df, *order)
    own = [PART] if group is None else [PART, group]
    upto = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({new: F.sum(c).over(upto) for new, c in sums.items()})
    totals = rows.groupBy(*own).agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    earlier = (Window.partitionBy(group) if group else Window).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    behind = totals.select(F.col(PART).alias("__p"), *([F.col(group).alias("__g")] if group else []), *[F.sum(f"__{new}").over(earlier).alias(f"__{new}") for new in sums])
    # a range holds at most one group that began in an earlier one
    behind = behind.where(F.coalesce(*[F.col(f"__{new}") for new in sums]).isNotNull())
    same = F.col(PART) == F.col("__p")
    joined = local.join(F.broadcast(behind), same & F.col(group).eqNullSafe(F.col("__g")) if group else same, "left")
    full = {new: F.coalesce(new, F.lit(0)) + F.coalesce(f"__{new}", F.lit(0)) for new in sums}
    return joined.withColumns(full).select(*df.columns, *sums)


def with_previous(df: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """df, in the order of columns (ascending), with values of the row before each:
    columns maps new names to columns; null for the first row."""
    rows = ranges(df, *map(F.col, order))
    within = Window.partitionBy(PART).orderBy(*order)
    local = rows.withColumns({new: F.lag(c).over(within) for new, c in columns.items()} | {AT: F.row_number().over(within)})
    backwards = Window.partitionBy(PART).orderBy(*[F.col(c).desc() for c in order])
    last = rows.withColumn(AT, F.row_number().over(backwards)).where(F.col(AT) == 1)  # a row for each range
    edge = last.select((F.row_number().over(Window.orderBy(PART)) + 1).alias("__nth"), *[F.col(c).alias(f"__{new}") for new, c in columns.items()])
    nth = last.select(F.col(PART).alias("__p"), F.row_number().over(Window.orderBy(PART)).alias("__nth"))
    joined = local.join(F.broadcast(nth.join(edge, "__nth")), F.col(PART) == F.col("__p"), "left")
    found = {new: F.when(F.col(AT) == 1, F.col(f"__{new}")).otherwise(F.col(new)) for new in columns}
    return joined.withColumns(found).select(*df.columns, *columns)
