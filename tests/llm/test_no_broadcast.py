"""Tables that grow with the input are never broadcast, however small Spark takes them."""

import random

import pytest

from scanloom.llm import common, near_dedup, simhash_dedup


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(5)
    rows = [(rng.getrandbits(63), i, 1) for i in range(2_000)]
    return common.spool(spark.createDataFrame(rows, "fp bigint, first_id bigint, group_size bigint"), "nodes")


@pytest.mark.parametrize("width", [1, 2])
def test_cells_around_fingerprints(nodes, width):
    assert broadcasts(simhash_dedup.links(nodes.select("fp"), width)) == 0


def test_pairs_by_fingerprint(nodes):
    assert broadcasts(near_dedup._by_fingerprint(nodes.withColumnRenamed("first_id", "sim"))) == 0


def test_only_hot_groups(nodes):
    """As keys alone for those that are not hot, and with their rows for those that are."""
    rows = nodes.select("fp", "first_id")
    assert broadcasts(common.join_groups(rows, nodes.drop("first_id"), "fp", rows.count(), many=True)) == 2
    assert broadcasts(common.join_groups(rows, nodes.drop("first_id"), "fp", rows.count())) == 3


def test_classes_of_documents(spark, monkeypatch):
    """None but those of hot groups, in all that operator 6 and the near stage write."""
    docs = common.spool(spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 20), k -> hash(k, id div 2))) AS text"), "docs")
    seen = []
    for module in (common, simhash_dedup, near_dedup):
        monkeypatch.setattr(module, "spool", lambda df, name, *a, **b: seen.append((name, broadcasts(df))) or SPOOL(df, name, *a, **b))
    assert broadcasts(simhash_dedup.near_groups(docs)) == 2
    for keep in (simhash_dedup.keep_first, near_dedup.keep_first):
        assert keep(docs).count() == 150
    hot = {"members": 2, "pairs": 2}
    assert {name for name, _ in seen} > {"nodes", "classes", "members", "pairs"}
    assert [x for x in seen if x[1] > hot.get(x[0], 0)] == []


SPOOL = common.spool
