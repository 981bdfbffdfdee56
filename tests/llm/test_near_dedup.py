"""The near-duplicate stage against brute-force Jaccard."""

import random

import corpus_pipeline


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """The least id of each group, ids unique."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                continue
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {find(i) for i in ids}


def test_stage_equals_brute_force(spark):
    """Among them 56 and 914: Jaccard 0.97, five bits of the operator's fingerprints apart."""
    folder = "/root/testdata/sf0.01"
    docs = corpus_pipeline.exact(spark, corpus_pipeline.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), folder)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    found = [r.doc_id for r in corpus_pipeline.near(spark, docs, folder).collect()]
    assert sorted(found) == sorted(want) and 56 in want and 914 not in want


def test_chains_and_large_groups(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, texts = [word() for _ in range(60)], []
    for _ in range(80):  # near copies of one text, linked to each other or not
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = word()
        texts.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(12):  # each is near the next only
        texts.append(chain)
        chain = [*chain[8:], *(word() for _ in range(8))]
    line = base[:9]
    texts += [[*line, *(word() for _ in range(rng.randrange(5, 60)))] for _ in range(60)]
    texts += [[w] * n for w in ("a", "b") for n in (1, 4, 5, 9)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert sorted(found) == sorted(brute(rows))


def test_groups_over_batches():
    """Pairs within groups are the same wherever the batches are cut."""
    import numpy as np
    import pyarrow as pa

    from scanloom.llm import near_dedup

    rng = np.random.default_rng(7)
    n = 60
    token = np.sort(rng.integers(0, 9, n))
    root = rng.integers(0, 3, n)
    cells = rng.integers(0, 2, (6, near_dedup.CELLS)).astype(np.uint8)
    fp = rng.permutation(n)
    rows = pa.RecordBatch.from_arrays(
        [
            *(pa.array(x.astype(np.int64)) for x in (token, 0 * token, 0 * token, 100 + 0 * token, rng.integers(0, 4, n), fp, root, 0 * token)),
            pa.array(np.ones(n, bool)),
            pa.array([cells[i % 6].tobytes() for i in fp], pa.binary()),
        ],
        ["token", "low", "high", "n", "pos", "fp", "root", "block", "upper", "cells"],
    )
    apart = 9 * np.abs(cells[:, None].astype(int) - cells[None]).sum(axis=2) <= 200
    want = {
        (min(fp[i], fp[j]), max(fp[i], fp[j]))
        for i in range(n) for j in range(i) if token[i] == token[j] and root[i] != root[j] and apart[fp[i] % 6, fp[j] % 6]
    }
    for size in (1, 7, n):
        parts = [rows.slice(i, size) for i in range(0, n, size)]
        found = [p for out in near_dedup._within_groups(iter(parts)) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)]
        assert set(found) == want and len(found) == len(want)
    assert list(near_dedup._within_groups(iter([]))) == []


def near_copies(n, rng, length=60, changed=3):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(changed)):
            copy[rng.randrange(length)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    return texts


def test_pairs_across_blocks(spark, monkeypatch):
    """Groups of many blocks, with components that only pairs of two blocks join."""
    from scanloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PAIRS", 64)
    rng = random.Random(5)
    texts = near_copies(70, rng, 40, 4) + near_copies(40, rng, 90, 8)
    line = " ".join(f"line{i}" for i in range(12))
    texts += [f"{line} " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(3))) for _ in range(90)]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    found = [r.doc_id for r in near_dedup.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(found) == sorted(brute(rows))


def test_a_group_of_one_component_is_not_exchanged(spark, monkeypatch):
    from scanloom.llm import near_dedup

    seen, plain = [], near_dedup.open_members

    def counted(met, known, n_met):
        rows = plain(met, known, n_met)
        seen.append((n_met, rows.count()))
        return rows

    monkeypatch.setattr(near_dedup, "open_members", counted)
    docs = spark.createDataFrame(list(enumerate(near_copies(3000, random.Random(2), 200, 2))), "doc_id bigint, text string")
    assert [r.doc_id for r in near_dedup.keep_first(docs).collect()] == [0]
    (met, members), = seen
    assert met > 10_000 and members < 500


def test_awkward_rows(spark):
    """Null and repeated ids, null texts, repeated rows and no rows at all."""
    from scanloom.llm import near_dedup

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (4, text + " x"), (4, "other words are here alone"), (4, None), (None, ""), (9, text), (9, text), (None, "alone again here now yes")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [tuple(r) for r in near_dedup.keep_first(docs).collect()]
    assert sorted(found, key=str) == sorted([(4, text + " x"), (4, "other words are here alone"), (4, None), (None, "alone again here now yes")], key=str)
    assert near_dedup.keep_first(docs.limit(0)).collect() == []
