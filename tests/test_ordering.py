"""Ranks, running sums and neighbours over ranges, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom.operators import ordering


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(3)
    return [(dice.choice([None, 1, 2, 2, 2, 3]), dice.randrange(40), i, dice.randrange(5)) for i in range(700)]


def test_numbered(spark, rows):
    df = spark.createDataFrame(rows, "g int, s int, id int, n int").repartition(5)
    found = {r.id: r.pos for r in ordering.numbered(df, F.desc("s"), F.col("id")).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert found == {r[2]: i + 1 for i, r in enumerate(want)}
    assert ordering.numbered(df.limit(0), F.col("id")).collect() == []


@pytest.mark.parametrize("group", [None, "g"])
def test_running_sums(spark, rows, group):
    df = spark.createDataFrame(rows, "g int, s int, id int, n int").repartition(5)
    order = [F.col("g"), F.col("s"), F.col("id")]
    found = {r.id: (r.a, r.b) for r in ordering.running_sums(df, order, {"a": "n", "b": "s"}, group).collect()}
    sums, want = {}, {}
    for g, s, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        key = g if group else 0
        a, b = sums.get(key, (0, 0))
        sums[key] = want[i] = (a + n, b + s)
    assert found == want


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_group_over_all_ranges(spark, many_ranges):
    df = spark.range(2000).select(F.lit("x").alias("g"), "id", F.lit(1).alias("n"))
    found = ordering.running_sums(df, [F.col("g"), F.col("id")], {"upto": "n"}, "g")
    assert found.where("upto <> id + 1").count() == 0
    assert ordering.ranges(df, F.col("g"), F.col("id")).select(ordering.PART).distinct().count() > 1


def test_with_previous(spark, rows):
    df = spark.createDataFrame(rows, "g int, s int, id int, n int")
    found = {r.id: (r.was, r.last) for r in ordering.with_previous(df, ["s", "id"], {"was": "n", "last": "id"}).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[2]))
    assert found == {b[2]: (a[3], a[2]) if a else (None, None) for a, b in zip([None, *want], want)}
