"""More of the training-data operators: published licences, filters in parts, the
positive-unlabelled risk and prior, the order of rules, awkward names and ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import bloom, exact_dedup, license_scan, mixing, near_dedup, packing, quality_model, quality_rules, simhash_dedup, url_filter

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{after} either version {n} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY.
"""
BSD = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."
PUBLISHED = {
    MIT: "MIT",
    APACHE: "Apache-2.0",
    GPL.format(mark=":", after=",", n=3): "GPL-3.0-or-later",
    GPL.format(mark=";", after=";", n=2): "GPL-2.0-or-later",
    BSD: "BSD-2-Clause",
    BSD + BSD_NAME: "BSD-3-Clause",
    MPL: "MPL-2.0",
    UNLICENSE: "Unlicense",
}


@pytest.mark.parametrize("leader", ["", "// ", " * ", "# ", "-- "])
def test_published_licences(spark, leader):
    texts = ["\n".join(leader + line for line in text.split("\n")) for text in PUBLISHED]
    flat = ["\n\n".join(" ".join(part.split()) for part in text.split("\n\n")) for text in PUBLISHED]  # lines not wrapped
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *flat, MIT + APACHE])], "doc_id bigint, text string")
    found = [r.licenses for r in license_scan.scan(docs).orderBy("doc_id").collect()]
    assert found == [*PUBLISHED.values(), *PUBLISHED.values(), "Apache-2.0,MIT"]


def test_parts_of_licence_sentences_are_none(spark):
    texts = ["We say that permission is hereby granted, free of charge", "Foo licensed under the MIT License or so", "not all rights reserved", "All rights reserved or not"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.sentence_codes for r in license_scan.scan(docs).collect()} == {""}


def test_filters_in_parts(spark, monkeypatch):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), F.when(F.col("id") % 5 == 0, F.col("id") % 50).otherwise(F.col("id"))).alias("text"))
    order = lambda df: sorted(tuple(r) for r in df.collect())
    want, kept = order(exact_dedup.dedup_report(docs)), order(exact_dedup.keep_one(docs))
    monkeypatch.setattr(bloom, "MAX_BITS", 1 << 15)
    assert order(exact_dedup.dedup_report(docs)) == want and order(exact_dedup.keep_one(docs)) == kept
    alone, shared, n = exact_dedup.split_keys(docs, "doc_id", "text")
    assert n == 9000 and alone.count() + shared.count() == n and alone.count() > 5000


def test_dotted_names_and_other_ids(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(f"k{i % 7}", " ".join(random.Random(i % 9).choices(words, k=20)), "en", "src0", i, i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, `a.b` int, `c d` int")
    for keep in (exact_dedup.keep_one, simhash_dedup.keep_first, near_dedup.keep_first):
        found = keep(docs)
        assert found.columns == docs.columns and sorted(r.text for r in found.collect()) == sorted({r[1] for r in rows})
    assert mixing.mix(docs, mixing.Plan(budget_share=2.0)).columns == docs.columns
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == {r[0] for r in rows}


def test_documents_without_an_id_are_mixed_one_by_one(spark):
    rows = [(None, f"{i} " * 10, "en", "src0") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    taken = mixing.mix(docs, mixing.Plan(budget_share=0.5)).count()
    assert 200 <= taken <= 201


# The classifier
def _model(prior, seed=0):
    rng = np.random.default_rng(seed)
    model = quality_model.Model(prior)
    w, h = quality_model.WIDTH, quality_model.HIDDEN
    model.weights = [rng.normal(0, 0.3, (w, h)), rng.normal(0, 0.1, h), rng.normal(0, 0.5, h), np.zeros(1)]
    return model, rng.normal(0, 1, (7, w)), rng.normal(0, 1, (11, w))


@pytest.mark.parametrize("prior", [0.05, 0.9])
def test_risk_and_gradient(prior):
    model, p, u = _model(prior)
    positive, negative = model.risk(p, u)
    g = lambda x: np.tanh(x @ model.weights[0] + model.weights[1]) @ model.weights[2] + model.weights[3]
    loss = lambda z: np.log1p(np.exp(-z))
    assert positive == pytest.approx(prior * loss(g(p)).mean())
    assert negative == pytest.approx(loss(-g(u)).mean() - prior * loss(-g(p)).mean())

    def stepped():  # what a step descends: the risk, or out of an overfit of the negatives
        a, b = model.risk(p, u)
        return a + b if negative >= 0 else -b

    for weights, gradient in zip(model.weights, model._gradients(p, u), strict=True):
        for at in list(np.ndindex(weights.shape))[:: max(1, weights.size // 9)]:
            old = weights[at]
            weights[at] = old + 1e-5
            more = stepped()
            weights[at] = old - 1e-5
            less = stepped()
            weights[at] = old
            assert gradient[at] == pytest.approx((more - less) / 2e-5, abs=1e-6)


def test_overfit_negatives_are_stepped_out_of():
    model, p, u = _model(0.9)
    model.weights[3][:] = -30  # all looks negative
    model.prior = 0.99
    u = u + 0
    p[:] = u[:7]
    model.weights[2] *= 0
    model.weights[3][:] = 2.0
    assert model.risk(p, u)[1] > 0
    model.prior = 1.5  # more positives than there are: the negatives' part is below zero
    assert model.risk(p, u)[1] < 0
    assert model._gradients(p, u)[3][0] > 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(4)
    rows = lambda n, mean: rng.normal(mean, 1, (n, quality_model.WIDTH)).astype(np.float32)
    unlabelled = np.concatenate([rows(int(3000 * share), 0.5), rows(3000 - int(3000 * share), -0.5)])
    found = quality_model.estimate_prior(rows(1500, 0.5), unlabelled[rng.permutation(3000)])
    assert found == pytest.approx(share, abs=0.08)


def test_fitting_rows_are_bounded_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "POSITIVES", 20)
    monkeypatch.setattr(quality_model, "UNLABELLED", 30)
    seen = []
    monkeypatch.setattr(quality_model, "estimate_prior", lambda p, u: seen.append((len(p), len(u))) or 0.5)
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality")).distinct()
    quality_model.fit(docs, labels)
    assert seen[0][0] <= 20 and seen[0][1] <= 30


# The cascade
def test_rules_are_ordered_by_rejections_per_cost_of_what_is_left():
    rejected = {"wide": set(range(100)), "same": set(range(95)), "other": set(range(100, 120)), "dear": set(range(120))}
    cost = {"wide": 1.0, "same": 1.0, "other": 1.0, "dear": 50.0}
    assert quality_rules.by_gain(rejected, cost) == ["wide", "other", "same", "dear"]


def test_rules_are_measured_where_they_run(spark):
    rules = [quality_rules.Rule("none", lambda t: t.n_words < 0), quality_rules.Rule("most", lambda t: t.n_words > 3)]
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 20).cast("int")).alias("text"))
    sample = quality_rules._counted(quality_rules._sample(docs, "doc_id", "text"))
    assert [r.name for r in quality_rules.order_rules(sample, rules, quality_rules.Counted(F.col("text")))] == ["most", "none"]


# The URL list
def test_a_list_of_many_hosts(spark):
    listed = spark.range(120_000).select(F.concat(F.lit("h"), "id", F.lit(".example.org")).alias("host"))
    urls = [f"http://www.h{i}.example.org/" for i in range(119_500, 121_000)] + ["http://example.org/", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, listed, rules=()).collect()}
    assert [found[i] for i in range(len(urls))] == ["block"] * 500 + ["allow"] * 1002


GPL2 = "is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.\n"
NOTICES = {
    "BSD-3-Clause": BSD + """
3. Neither the name of Foo Bar, Inc. nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.
""",
    "BSD-2-Clause": BSD,
    "GPL-2.0-only": "This program " + GPL2,
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "CC0-1.0": "To the extent possible under law, Jane Doe has waived all copyright and\nrelated or neighboring rights to The Example Corpus. This work is published from: Utopia.",
    "MIT": "// SPDX-License-Identifier: MIT\nint main() {}\n",
    "LGPL-3.0-or-later": "# SPDX-License-Identifier: LGPL-3.0-or-later",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-or-later": GPL.format(mark=";", after=";", n=2),
    "": "Neither the name of the town nor the names of its rivers are known to me. SPDX-License-Identifier: ",
}


def test_licences_with_names(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES.values())), "doc_id int, text string")
    found = {r.doc_id: r.licenses for r in license_scan.scan(docs).collect()}
    assert [found[i] for i in range(len(NOTICES))] == list(NOTICES)


def test_slots_are_bounded(spark):
    line = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    texts = [line.format(" ".join(["x"] * n)) for n in (1, 12, 13)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [r.n_sentences for r in license_scan.scan(docs).orderBy("doc_id").collect()] == [1, 1, 0]
