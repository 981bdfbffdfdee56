"""Operator 12 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import resampling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, targets, percent, least, buckets, seed=7):
    """docs (id, text): (id, n_words, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in targets for f in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, targets, percent, least, buckets=97):
    df = spark.createDataFrame(docs, "`doc.id` bigint, `a text` string").withColumns({"doc_id": F.lit("x"), "rank": F.lit(1), "score": F.lit(0)}).repartition(3)
    to = spark.createDataFrame([(t,) for t in targets], "`a text` string")
    found = resampling.draw(df, to, percent, least, id_col="doc.id", text_col="a text", buckets=buckets)
    return sorted(map(tuple, found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("part", [1 << 20, 16])
def test_draw(spark, monkeypatch, part):
    monkeypatch.setattr(resampling, "PART", part)  # 16: every text goes through in parts
    monkeypatch.setattr(resampling, "BLOCK", 60)
    monkeypatch.setattr(resampling, "KNOWN", 5)
    dice = random.Random(part)
    words = ["Red", "red", "blau", "größe", "Ünder", "a1b2", "x", "\u0085y", "日本", " ", "end.", "(b)", "long" * 9]
    text = lambda: dice.choice([" ", "\n", "--"]).join(dice.choice(words) for _ in range(dice.randrange(30)))
    docs = [(dice.choice([None, 5, i]), dice.choice([None, "", text(), text(), text()])) for i in range(300)]
    docs += [docs[-1]] * 7
    targets = [text() for _ in range(20)] + [None, ""]
    assert run(spark, docs, targets, 25, 5) == brute(docs, targets, 25, 5, 97)


def test_ends(spark):
    docs = [(1, "one two three"), (2, None)]
    assert run(spark, [], ["a b"], 25, 1) == []
    assert run(spark, docs, [], 100, 1) == brute(docs, [], 100, 1, 97)
    assert run(spark, docs, ["one"], 0, 1) == brute(docs, ["one"], 0, 1, 97)


def test_long_text(spark):
    docs = [(1, "word " * 400_000 + "end"), (2, "x" * 3_000_000), (3, "a b")]
    assert run(spark, docs, ["word word end"], 100, 1) == brute(docs, ["word word end"], 100, 1, 97)


def test_blocks_hold_the_whole_matrix(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 10)
    docs = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(12)]
    blocks = resampling.csr_blocks(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), 1000).collect()
    assert len(blocks) > 5
    rows = [(i, n) for b in blocks for i, n in zip(b.doc_ids, b.n_features)]
    assert rows == [(i, len(features(t)[1])) for i, t in docs]
    assert all(4 * b.ends[-1] == len(b.cols) == len(b.counts) for b in blocks)
    assert all(np.frombuffer(b.counts, resampling.NUMBER).sum() == sum(b.n_features) for b in blocks)


def test_resample_returns_rows(spark):
    docs = [(i, f"word{i} alpha beta", i) for i in range(40)] + [(None, "alpha beta", 77)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, extra int")
    to = spark.createDataFrame([("alpha",)], "text string")
    drawn = {r.doc_id for r in resampling.draw(df, to, 50, 1).where("rank is not null").collect()}
    found = resampling.resample(df, to, 50, least=1)
    assert found.columns == df.columns and {r.doc_id for r in found.collect()} == drawn and len(drawn) == 20
