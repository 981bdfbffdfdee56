"""The pipeline stage by stage against brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from scanloom.llm import mixing, packing

from test_near_dedup import brute


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = [c for c in text if c.isalpha()]
    return (
        len(words) >= 10
        and 100 * len(covered) <= 20 * len(words)
        and 4 * sum(c in "#*$%&|<>" for c in text) <= len(words)
        and 2 * sum(c.isupper() for c in letters) <= len(letters)
        and 2 * (len(lines) - len(set(lines))) <= len(lines)
        and 2 <= sum(map(len, words)) / len(words) <= 16
    )


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    assert all(df.columns == columns for df in out[:-1])

    kept = {i for i, t in rows.items() if good(t)}
    assert {r.doc_id for r in out[0].collect()} == kept

    by_text = {}
    for i in sorted(kept):
        by_text[lower(rows[i])] = i
    once = set(by_text.values())
    assert {r.doc_id for r in out[1].collect()} == once

    assert {r.doc_id for r in out[2].collect()} == brute([(i, rows[i]) for i in once])

    report = {r.doc_id: r.copies for r in mixing.mix_report(out[2], mixing.Plan()).collect()}
    mixed = Counter(r.doc_id for r in out[3].collect())
    assert mixed == Counter({i: n for i, n in report.items() if n})
    assert all(r.text == rows[r.doc_id] for r in out[3].collect())

    tokens = defaultdict(int)
    for r in out[4].collect():
        tokens[r.doc_id] += r.length
    bpe = packing.encoder()
    assert tokens == {i: n * len(packing.tokens(rows[i], bpe)) for i, n in mixed.items()}


def test_run_equals_stages(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0 and "sequence_id" in found.columns
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
