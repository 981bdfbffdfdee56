"""Operators 7 and 9 on columns whose names hold dots."""

from scanloom.llm import sharding, url_filter


def test_dotted_names(spark):
    pages = spark.createDataFrame([(1, "https://www.example.com/en/a"), (2, None)], "`page.id` bigint, `the url` string")
    listed = spark.createDataFrame([("example.com",)], "host string")
    found = {r.page_id: (r.host, r.rule) for r in url_filter.judge(pages, listed, id_col="page.id", url_col="the url").collect()}
    assert found == {1: ("www.example.com", "www.example.com/en/"), 2: ("", None)}
    docs = spark.createDataFrame([(1, "abc"), (None, None)], "`doc.id` bigint, `a.text` string")
    shards = sharding.assign_shards(docs, 2, id_col="doc.id", text_col="a.text").collect()
    assert {(r.doc_id, r["size"]) for r in shards} == {(1, 19), (None, 16)}
