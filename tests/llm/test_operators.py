"""The training-data operators against brute force, and on awkward tables: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanloom.llm import (
    bloom,
    catalog,
    common,
    components,
    exact_dedup,
    language_model,
    license_scan,
    mixing,
    packing,
    quality_model,
    quality_rules,
    sharding,
    simhash_dedup,
    url_filter,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 701}x{i % 13}" for i in range(60_000))
AWKWARD = [
    (1, "Same text here", "en", "src0", 14),
    (2, "SAME text here", "en", "src0", 14),
    (2, "same TEXT here", None, "src1", 14),
    (3, "same text here", "en", None, 14),
    (3, "same text here", "en", None, 14),
    (4, None, None, None, None),
    (5, "", "en", "src2", 0),
    (None, "same text here", "de", "src2", 14),
    (None, None, None, "src3", None),
    (6, LONG, "en", "src9", len(LONG)),
    (7, LONG + " more", "en", "src9", len(LONG) + 5),
    (8, "\u00c9t\u00e9 \u00c9T\u00c9 \U0001f600 \u0130\u00df\n\n\n", "fr", "src5", 12),
    (9, "\u00e9t\u00e9 \u00e9t\u00e9 \U0001f600 \u0130\u00df\n\n\n", "fr", "src5", 12),
    (10, " \t\r\n\x0b\x0c ", "en", "src4", 7),
    (11, "one", "en", "src4", 3),
    (12, "one two", "en", "src4", 7),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """With columns whose names the operators use themselves."""
    rows = spark.createDataFrame(AWKWARD, SCHEMA)
    clash = "digest kept leaf key copies shard size row fp rid group_size maybe_gone taken bucket".split()
    return rows.select("*", *[F.lit(f"{c}!").alias(c) for c in clash])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, small, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found, want = catalog.QUERIES[name](spark, small).toPandas(), db.sql(catalog.ORACLES[name]).df()
    pd.testing.assert_frame_equal(rows(found), rows(want), check_dtype=False)


# Bloom filters and components
def test_bloom_filter_never_misses(spark):
    keys = spark.range(5000).withColumn("key", F.concat(F.lit("k"), F.col("id")))
    pages = bloom.pages_for(2500)
    built = bloom.build_from_keys(keys.where("id < 2500"), "key", pages, 4)
    found = keys.where(bloom.maybe(built.scalar(), F.col("key"), pages, 4)).agg(F.count("*"), F.count_if(F.col("id") < 2500)).first()
    assert found[1] == 2500 and found[0] < 2700
    assert bloom.pages_for(10**12) * bloom.PAGE_BITS == bloom.MAX_BITS


def test_filter_of_windows_never_misses(spark):
    keys = spark.range(50000).withColumn("key", F.concat(F.lit("k"), F.col("id")))
    pages = bloom.pages_for(25000)
    built = bloom.build_windows(keys.where("id < 25000"), "key", pages)
    found = keys.where(bloom.maybe_window(built.scalar(), F.col("key"), pages)).agg(F.count("*"), F.count_if(F.col("id") < 25000)).first()
    assert found[1] == 25000 and found[0] < 25800


def test_keys_filter_goes_to_the_tasks_once(spark):
    """A plan's tasks are sent the filter as often as the plan names it."""
    keys = spark.range(1000).withColumnRenamed("id", "key")
    for part in common.split_by_keys(spark.range(3000), "id", keys, "key"):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("scalar-subquery#") <= 2  # the filter's name and its subquery below


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = sorted((root(a), root(b)))
        parent[v] = u
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {x: found.get(x, x) for x in linked} == {x: root(x) for x in linked}


@pytest.mark.parametrize("part", [1, 8, 50])
def test_components_of_many_parts(spark, monkeypatch, part):
    """Parts of links that are held by several tasks, or by one after another."""
    rng = random.Random(part)
    chain = rng.sample(range(200), 60)
    edges = [*zip(chain, chain[1:], strict=False), *((300, 300 + i) for i in range(60)), (5, 5)]
    monkeypatch.setattr(components, "PART", part)
    links = spark.createDataFrame(rng.sample(edges, len(edges)), "a bigint, b bigint")
    found = sorted(tuple(r) for r in components.components(links.repartition(5)).collect())
    assert found == sorted([(x, min(chain)) for x in chain if x > min(chain)] + [(300 + i, 300) for i in range(1, 60)])


def test_components_take_few_jobs(spark):
    """A graph that a task can hold takes no rounds, which fill the driver's memory."""
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "components")
    try:
        found = components.components(spark.range(500).selectExpr("id AS a", "id + 1 AS b"))
        assert found.where("root = 0").count() == 500
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(name, None)
    assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) <= 8


def test_no_links(spark):
    assert components.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


# 1: mixing
def test_budgets_go_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)]
    plan = mixing.Plan(budget_share=200 / 3010, max_epochs=1, weights={"domain": {"a": 1.0, "b": 1.0}, "lang": {"en": 1.0, "de": 1.0}, "source": {}})
    found = mixing.quotas(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), plan)
    quota = {r.source: r.quota for r in found.collect()}
    assert quota == pytest.approx({"s1": 10, "s2": 40, "s3": 50, "s4": 100})
    plan = mixing.Plan(budget_share=4000 / 3010, max_epochs=1, weights=plan.weights)  # more than there is
    found = mixing.quotas(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint"), plan)
    assert {r.source: r.quota for r in found.collect()} == pytest.approx({"s1": 10, "s2": 1000, "s3": 1000, "s4": 1000})


def test_mix_meets_its_quotas_and_agrees_with_its_report(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = mixing.Plan()
    report = mixing.mix_report(docs, plan).toPandas()
    assert len(report) == docs.count() and (report.copies <= plan.max_epochs).all()
    for _, leaf in report.groupby(["domain", "lang", "source"]):
        taken = (leaf.copies * leaf.n_tokens).sum()
        assert leaf.leaf_quota.iloc[0] - 1e-3 <= taken < leaf.leaf_quota.iloc[0] + leaf.n_tokens.max() + 1
    mixed = mixing.mix(docs, plan)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({r.doc_id: r.copies for r in report.itertuples() if r.copies})


def test_mix_awkward(awkward, empty):
    report = mixing.mix_report(awkward, mixing.Plan())
    assert report.count() == len(AWKWARD)
    mixed = mixing.mix(awkward, mixing.Plan(budget_share=2.0))
    assert mixed.columns == awkward.columns and {r.digest for r in mixed.collect()} == {"digest!"}
    assert mixing.mix(empty, mixing.Plan()).count() == 0 == mixing.mix_report(empty, mixing.Plan()).count()


# 2: classifier
def test_classifier_separates_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_model.op2_quality_classifier(spark, folder).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(found.doc_id, found.held_out, strict=True))
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 0].score.mean() < 0.2 and held[held.quality == 1].score.mean() > 0.8


def test_classifier_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (6, 1), (None, 1)], "doc_id bigint, quality int")
    docs = awkward.select("doc_id", "text")
    model = quality_model.fit(docs, labels)
    found = quality_model.score(docs, model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found) and all(r.held_out for r in found if r.doc_id is None)
    none = quality_model.fit(docs, labels.limit(0))
    assert {r.score for r in quality_model.score(docs, none).collect()} == {0.5}
    assert quality_model.score(empty, quality_model.fit(empty, labels.limit(0))).count() == 0


# 3: licences
def test_licence_rules(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0. Hello": "Apache-2.0",
        "Foo.\n  RELEASED under the   MIT-License!\nLicensed under CC BY-NC 4.0.": "MIT,CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "I like the MIT License.": "",
        "A released under the MIT License.": "",
        "All rights reserved.": "Proprietary",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [found[i].licenses for i in range(len(texts))] == list(texts.values())
    assert found[1].restricted and found[5].restricted and not found[0].restricted and found[1].sentence_codes == "<mit-name><cc-by-nc>"


def test_licence_awkward(awkward, empty):
    assert {r.licenses for r in license_scan.scan(awkward).collect()} == {""}
    assert license_scan.scan(empty).count() == 0


# 4: quality rules
def brute_rules(text):
    text = text or ""
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(spark, awkward):
    rng = random.Random(5)
    made = [" ".join(rng.choice("ab c# d|".split()) for _ in range(rng.randrange(60))) + "\n" * rng.randrange(3) + "x y\nx y\n y" for _ in range(40)]
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string"))
    texts = docs.collect()
    found = quality_rules.quality_report(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    want = Counter()
    for r in texts:
        b = brute_rules(r.text)
        want[(r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want and not any(r.kept for r in found if r.base_failed)


def test_rules_do_not_depend_on_their_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    text = F.coalesce("text", F.lit(""))
    backward = docs.where(quality_rules.cascade(list(reversed(quality_rules.BASE_RULES + quality_rules.MORE_RULES)), quality_rules.Text(text)))
    assert kept == {r.doc_id for r in backward.collect()}
    assert kept == {r.doc_id for r in quality_rules.quality_report(docs).where("kept").collect()}


def test_rules_empty(empty):
    assert quality_rules.quality_report(empty).count() == 0 == quality_rules.keep_good(empty).count()


# 5: language model
def brute_model(docs):
    texts = [(i, [*words(lower(t)), None]) for i, t in docs]
    train = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in train for w in t)
    two = {k: c for k, c in Counter(p for t in train for p in zip(t, t[1:], strict=False)).items()}
    three = {k: c for k, c in Counter(p for t in train for p in zip(t, t[1:], t[2:], strict=False)).items()}
    n, v, d = sum(one.values()), len(one), language_model.DISCOUNT
    mass2, mass3 = defaultdict(float), defaultdict(float)
    for (a, _), c in two.items():
        mass2[a] += (c - d) / one[a]
    for (a, b, _), c in three.items():
        mass3[a, b] += (c - d) / two[a, b]

    def step(p):
        import numpy as np

        return language_model._VALUES[language_model.quantise(np.array([p]))[0]]

    out = []
    for i, t in texts:
        base = score = 0.0
        for j, w in enumerate(t):
            base += math.log10((one[w] + 1) / (n + v + 1))
            p = max(one[w] - d, 0) / n + d * v / n / (v + 1)
            if j and t[j - 1] in mass2:
                p = step(1 - mass2[t[j - 1]]) * p + (step((two[t[j - 1], w] - d) / one[t[j - 1]]) if (t[j - 1], w) in two else 0)
            if j > 1 and (t[j - 2], t[j - 1]) in mass3:
                c = (t[j - 2], t[j - 1])
                p = step(1 - mass3[c]) * p + (step((three[(*c, w)] - d) / two[c]) if (*c, w) in three else 0)
            score += math.log10(p)
        out.append((i, len(t), sum(w in one for w in t), base, score))
    return n, out


@pytest.mark.parametrize("shard", [None, 3000])
def test_language_model_equals_brute_force(spark, small, monkeypatch, shard):
    if shard:  # many shards and batches; contexts that lie in several
        for name, value in (("TOKENS_A_SHARD", shard), ("WORDS_A_SHARD", 500), ("TEXT_BATCH", 2000), ("ID_BATCH", 3000), ("WORDS_HELD", 700)):
            monkeypatch.setattr(language_model, name, value)
    found = {r.doc_id: r for r in language_model.op5_trie_language_model(spark, small).collect()}
    n, want = brute_model([(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])
    assert len(found) == len(want)
    for i, tokens, known, base, score in want:
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-5, abs=1e-3)


def test_token_hashes(monkeypatch):
    monkeypatch.setattr(language_model, "HASHED", 64)
    texts = [*(t or "" for _, t, *_ in AWKWARD if t not in (LONG, LONG + " more")), "x" * 500 + " y", "\x00 \x00\x00 a\x00", " A a"]
    hashes, sizes = language_model.token_hashes([t.encode() for t in texts])
    tokens = [w for t in texts for w in (*words(lower(t)), None)]
    assert sizes.tolist() == [len(words(t)) + 1 for t in texts] and len(tokens) == len(hashes)
    assert len(set(zip(tokens, hashes.tolist(), strict=True))) == len(set(tokens)) == len(set(hashes.tolist()))
    assert language_model.token_hashes([])[0].tolist() == []


def scored(spark, docs, tmp_path):
    words_ = language_model.build_words(language_model.count_words(docs.where(~language_model.is_held_out(F.col("doc_id")))), f"file://{tmp_path}/trie")
    ids = language_model.number_words(docs, words_)
    return language_model.score(ids, language_model.train(ids, words_)).collect()


def test_language_model_awkward(spark, awkward, empty, tmp_path):
    found = scored(spark, awkward.select("doc_id", "text"), tmp_path)
    assert len(found) == len(AWKWARD) and all(r.held_out for r in found if r.doc_id is None)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found) and {r.n_tokens for r in found if r.doc_id in (4, 5, 10)} == {1}
    assert scored(spark, empty.select("doc_id", "text"), tmp_path / "none") == []


# 6: SimHash
def brute_groups(docs):
    prints = {}
    for i, t in docs:
        prints.setdefault(simhash_dedup.fingerprint(t), []).append(i)
    keys = list(prints)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        ids = [i for i in prints[k] if i is not None]
        if ids:
            least[root(k)] = min(least.get(root(k), min(ids)), min(ids))
    return {(i, f"{k:016x}", least.get(root(k))) for k in keys for i in prints[k]}


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, text, *_ in AWKWARD:
        if text != LONG and text != LONG + " more":
            assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)
    part = " ".join(LONG.split()[:500])
    assert simhash_dedup.fingerprint(part) == plain_fingerprint(part)


def test_groups_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    found = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.op6_simhash_groups(spark, folder).collect()}
    assert found == brute_groups([(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])


def test_all_links_within_three_bits_are_found(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:40]:
        for n in (1, 2, 3, 4):
            q = p
            for b in rng.sample(range(64), n):
                q ^= 1 << b
            prints.append(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    found, of_bits = ({(r.a, r.b) for r in simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), width).collect()} for width in (2, 1))
    mask = (1 << 64) - 1
    assert found == of_bits == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_groups_awkward(awkward, empty):
    found = {(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash_dedup.near_groups(awkward).collect()}
    assert found == brute_groups([(r[0], r[1]) for r in AWKWARD])
    kept = simhash_dedup.keep_first(awkward)
    assert kept.columns == awkward.columns
    least = {c for _, _, c in found}
    assert {r.doc_id for r in kept.collect()} == least
    assert simhash_dedup.near_groups(empty).count() == 0 == simhash_dedup.keep_first(empty).count()


# 7: URLs
def test_urls(spark):
    urls = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://WWW.Example.com/en/1?x=/es/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "http://example.com/fr/": ("example.com", "/fr/", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
        "x://a.net?/es/": ("a.net", "", None, "allow"),
        "https://www.spam-farm.example.org/de/1#a": ("www.spam-farm.example.org", "/de/1", None, "block"),
        "https://xspam-farm.example.org/": ("xspam-farm.example.org", "/", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        "http://a.org/\u00e9 " + "y" * 100_000: ("a.org", "/\u00e9 " + "y" * 100_000, None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None])], "page_id bigint, url string")
    listed = spark.createDataFrame([(x,) for x in url_filter.LISTED], "host string")
    found = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, listed).collect()}
    assert [found[i] for i in range(len(urls))] == list(urls.values()) and found[len(urls)] == urls[None]
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("h"), "id").alias("host"), (F.xxhash64("id") % 7 == 0).alias("listed"))
    cascade = url_filter.Cascade(universe)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("host")) != F.col("listed")).count() == 0
    nothing = url_filter.Cascade(universe.withColumn("listed", F.lit(False)))
    assert universe.where(nothing.contains(F.col("host"))).count() == 0
    everything = url_filter.Cascade(universe.withColumn("listed", F.lit(True)))
    assert universe.where(~everything.contains(F.col("host"))).count() == 0


# 8: packing
@pytest.fixture(scope="module")
def first_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(["<|endoftext|>", " ", "\n", "<|endoftext|", "|>"])), max_size=6).map("".join))
def test_tokens_equal_the_first_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(test_tokens_equal_the_first_library, "t"):
        test_tokens_equal_the_first_library.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = packing.encoder()
    want = test_tokens_equal_the_first_library.t.encode(text, add_special_tokens=False).ids
    assert packing.tokens(text, bpe).tolist() == [*want, 1]
    if packing.ADDED not in text:
        assert [i for part in packing.chunks(text, 5) for i in bpe.encode_ordinary(part)] == want


def check_pieces(pieces, docs, tokenize):
    """An exact round trip, and little padding."""
    own = defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
    lengths, ids = defaultdict(int), defaultdict(list)
    for i, text in docs:
        ids[i].append(tokenize(text))
    assert set(own) == set(ids)
    for i, found in own.items():
        if len(ids[i]) > 1:
            assert sum(p.length for p in found) == sum(map(len, ids[i]))
            continue
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i][0])
            part = b"".join(x.to_bytes(4, "little") for x in ids[i][0][at : at + p.length])
            assert zlib.crc32(part) == p.ids_crc32
            at += p.length
        assert at == len(ids[i][0])
    filled = defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE_TOKENS
        lengths[at] += 1
    return sum(n * (packing.SEQUENCE_TOKENS - size) for size, n in lengths.items())


def test_packing_round_trip(spark, small, first_tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    pieces = packing.pack_documents(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    padding = check_pieces(pieces, texts, lambda t: [*first_tokenizer.encode(t, add_special_tokens=False).ids, 1])
    assert padding < packing.SEQUENCE_TOKENS


def test_packing_awkward(awkward, empty, first_tokenizer):
    pieces = packing.pack_documents(awkward.coalesce(1)).collect()
    check_pieces(pieces, [(r[0], r[1]) for r in AWKWARD], lambda t: [*first_tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    assert packing.pack_documents(empty).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_pack_places_every_token_once(lengths):
    pieces = packing.pack(lengths, 16)
    used = defaultdict(list)
    taken = defaultdict(set)
    for doc, start, size, s, offset in pieces:
        span = range(start, start + size)
        assert size > 0 and not taken[doc] & set(span)
        taken[doc] |= set(span)
        used[s].append((offset, size))
    assert all(len(taken[d]) == n for d, n in enumerate(lengths))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert len(used) == sum(n // 16 for n in lengths) + -(-sum(n % 16 for n in lengths) // 16)


# 9: shards
def test_shards_equal_brute_force(spark, awkward):
    docs = awkward.select("doc_id", "text")
    found = sharding.assign_shards(docs, 5).collect()
    table = sorted(
        ((r.doc_id is not None, r.doc_id or 0), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in docs.collect()
    )
    total, at, want, slots = sum(s for *_, s in table), 0, Counter(), Counter()
    for (_, i), crc, size in table:
        shard = min((2 * at + size) * 5 // (2 * total), 4)
        want[(i, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
        at += size
    assert Counter((r.doc_id or 0, r.size, r.text_crc32, r.shard, r.slot) for r in found) == want


def test_shards_are_even(spark, small, empty):
    found = sharding.op9_byte_shards(spark, small).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert abs(sizes - found["size"].sum() / 40).max() <= found["size"].max() and set(found.law) == {"bytes"}
    assert all(sorted(g) == list(range(len(g))) for _, g in found.groupby("shard").slot)
    assert found.sort_values("doc_id")["shard"].is_monotonic_increasing
    assert sharding.assign_shards(empty, 40).count() == 0


# 10: exact dedup
def test_exact_dedup_awkward(awkward, empty):
    groups = defaultdict(list)
    for i, text, *_ in AWKWARD:
        groups[lower(text)].append(i)
    found = exact_dedup.dedup_report(awkward).collect()
    order = lambda i: -1 if i is None else i
    want = Counter()
    for text, ids in groups.items():
        for i in ids:
            want[(i, max(ids, key=order), len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(groups)
    assert Counter(lower(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.dedup_report(empty).count() == 0 == exact_dedup.keep_one(empty).count()


def test_hot_groups(spark):
    """A group of a third of all rows, and many small ones."""
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("text")
    )
    found = exact_dedup.dedup_report(docs).toPandas()
    assert len(found) == 6000 and found.groupby("text_sha256").kept.sum().eq(1).all()
    assert found[found.group_size == 2000].keep_id.unique().tolist() == [5997]
    assert exact_dedup.keep_one(docs).count() == found.text_sha256.nunique()
