"""Rows, not ids, are dropped: null and repeated ids."""

from collections import Counter

from scanloom.llm import simhash_dedup


def test_one_row_of_each_component(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    rows = [(5, "a"), (5, "b"), (3, "B"), (None, "c"), (None, "d"), (1, "D"), (7, "e"), (7, "E"), (7, "e")]
    data = [(i, texts[k.lower()].upper() if k.isupper() else texts[k], k) for i, k in rows]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, name string")
    found = Counter((r.doc_id, r.name.lower()) for r in simhash_dedup.keep_first(docs).collect())
    assert found == Counter([(5, "a"), (3, "b"), (None, "c"), (1, "d"), (7, "e")])
