"""Filters beyond their largest size: parts with a filter of their own, and no plan with two."""

import pytest
from pyspark.sql import functions as F

from scanloom.llm import bloom, exact_dedup, url_filter


@pytest.fixture
def one_page(monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", bloom.PAGE_BITS)


def filters_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery")


def test_hosts_in_parts(spark, one_page):
    listed = spark.range(50_000).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".org")).alias("host"))
    assert url_filter.parts_for(100_000, 50_000) == 3
    pages = spark.range(100_000).select("id", F.concat(F.lit("http://h"), "id", F.lit(".org/en/")).alias("url"))
    found = url_filter.judge(pages, listed, id_col="id")
    assert filters_of(found) == 0
    assert found.count() == 100_000 == found.select("page_id").distinct().count()
    assert found.where((F.col("verdict") == "block") != (F.col("page_id") % 2 == 0)).count() == 0


def test_parts_grow_with_the_list_alone():
    assert url_filter.parts_for(0, 0) == url_filter.parts_for(10**12, 0) == 1
    assert url_filter.parts_for(10**9, 2 * 10**8) > 1
    for n_all, n_in in ((10**9, 2 * 10**8), (10**12, 10**9), (10**9, 10**9)):
        parts = url_filter.parts_for(n_all, n_in)
        k = url_filter.probes(n_in // parts, (n_all - n_in) // parts)
        assert n_in / parts * k / 0.6931 <= bloom.MAX_BITS * 1.01


def test_texts_in_parts_hold_no_filter_in_the_final_plan(spark, one_page):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 10 == 0, F.lit(0)).otherwise(F.col("id"))).alias("text"))
    alone, shared, n = exact_dedup.split_keys(docs, "doc_id", "text")
    assert filters_of(alone) == filters_of(shared) == 0
    assert alone.count() + shared.count() == n == 9_000
    report = exact_dedup.dedup_report(docs)
    assert report.where("kept").count() == 8_101
    assert report.where("group_size = 900").select("keep_id").distinct().collect() == [(8_990,)]
