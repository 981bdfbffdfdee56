"""Operator 11 against plain Python, over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from scanloom.llm import ranking


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute(rows, k):
    """rows (g, h, first, second, t, u): (g, h, first, second, t, u, pos, tied)."""
    groups, found = {}, []
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    up = lambda v: (v is None, v or 0)
    for own in groups.values():
        own.sort(key=lambda r: (r[2] is not None, -(r[2] or 0), r[3] is not None, r[3] or 0, up(r[4]), up(r[5])))
        for i, r in enumerate(own[: max(k, 0)]):
            found.append((*r, i + 1, sum(x[2:4] == r[2:4] for x in own)))
    return sorted(found, key=str)


def run(df, k):
    found = ranking.first_places(df, ["g", "h.x"], "first", "second", ["t", "u"], k)
    return sorted(map(tuple, found.select("g", "`h.x`", "first", "second", "t", "u", "pos", "tied").collect()), key=str)


def table(spark, rows):
    df = spark.createDataFrame(rows, "g string, `h.x` bigint, first bigint, second bigint, t bigint, u bigint")
    return df.withColumns({"a": F.lit(1), "n": F.lit("x"), "pos_": F.lit(0), "tied_": F.lit(0), "rows": F.lit(0)})  # names that the operator uses


@pytest.mark.parametrize("k", [1, 2, 7, 400])
def test_places(spark, many_ranges, k):
    dice = random.Random(k)
    rows = []
    for _ in range(900):
        hot = dice.random() < 0.4
        rows.append((
            "hot" if hot else dice.choice([None, "", "a", "b"]), 1 if hot else dice.choice([None, 1, 2]),
            dice.choice([None, -3, 0, 2, 2]), dice.choice([None, 5, -1, 1 << 40]), dice.choice([None, 1, 2]), dice.choice([None, 3]),
        ))
    assert run(table(spark, rows), k) == brute(rows, k)


def test_wide_numbers_and_equal_lines(spark):
    top = (1 << 63) - 1
    rows = [("a", 0, top - 1, -top, 1, 1), ("a", 0, -top, top, 1, 1), ("a", 0, -top - 1, 0, None, 1), ("a", 0, 7, top, 1, None)] + [("b", 0, 1, 1, 1, 1)] * 50
    for k in (1, 3, 20):
        assert run(table(spark, rows), k) == brute(rows, k)


def test_no_rows(spark):
    assert run(table(spark, []), 2) == []
    assert run(table(spark, [("a", 1, 1, 1, 1, 1)]), 0) == []


def test_ties_beyond_the_last_place_are_counted(spark):
    rows = [("g", 1, 4, 4, i, i) for i in range(300)]
    assert {r[-1] for r in run(table(spark, rows), 2)} == {300}
    assert len(run(table(spark, rows), 2)) == 2
