"""The language model holds every n-gram of the training rows, also those seen once."""

import zlib

from pyspark.sql import functions as F

from scanloom.llm import language_model


def test_once_seen_ngrams_are_held(spark, tmp_path):
    texts = ["a b c d", "a b e", "f g", "c d a b c", ""]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    words = language_model.build_words(language_model.count_words(docs.where(~language_model.is_held_out(F.col("doc_id")))), f"file://{tmp_path}/trie")
    model = language_model.train(language_model.number_words(docs, words), words)
    tokens = [[*t.split(), None] for t in texts]
    two = {p for t in tokens for p in zip(t, t[1:], strict=False)}
    three = {p for t in tokens for p in zip(t, t[1:], t[2:], strict=False)}
    assert (model.bigrams.bases[-1], model.trigrams.bases[-1]) == (len(two), len(three))
