"""Licence scan by sentence rules (operator 3, native).

A text is normalised: A-Z lower-cased, runs of anything but a-z and 0-9 to one space,
or to a boundary where such a run has a line end, or a mark . ! ? ; : before white
space. A known licence sentence is found where its words stand between two boundaries,
whatever boundaries lie inside it: so a sentence may be wrapped over lines, with
comment leaders, and may be a clause or a line of its own, but not a part of one. A
sentence may have slots, {}, for names of one to SLOT words.
Sentences are mapped to their identifiers. The identifiers of a text, in order, are
matched against the licence rules in their order; what a rule matches is used up, so
that a more special rule hides the more general ones.

A text none of whose words is the longest word of a known sentence can't contain
one, and isn't normalised; that test is exact. A null or empty text has no sentences.
Texts are read whole; repeated rows get equal results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, documents, quoted

# Identifiers of open licences that a line may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
# Known sentences as they stand in licences and their usual notices, with
# their identifiers.
SENTENCES = (
    ("apache-name", "Licensed under the Apache License, Version 2.0"),
    ("apache-grant", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-use", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-name", "Released under the MIT License"),
    ("mit-name", "Licensed under the MIT License"),
    ("mit-name", "This project is licensed under the MIT License"),
    (
        "mit-grant",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    (
        "isc-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("gpl3-name", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl-terms-3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    (
        "gpl-terms-2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 2 of the License, or (at your option) any later version",
    ),
    (
        "gpl-2-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ),
    (
        "gpl-2-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "version 2 of the License",
    ),
    (
        "gpl-3-only",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "version 3 of the License",
    ),
    ("gpl-only-2", "version 2 of the License"),
    ("gpl-only-3", "version 3 of the License"),
    ("gpl-later-3", "either version 3 of the License, or (at your option) any later version"),
    ("gpl-later-2", "either version 2 of the License, or (at your option) any later version"),
    (
        "lgpl-terms",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    (
        "lgpl-terms",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    ("lgpl-later", "either version 2.1 of the License, or (at your option) any later version"),
    (
        "agpl-terms",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    ("bsd-use", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    (
        "bsd-binary",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution",
    ),
    (
        "bsd-name",
        "Neither the name of {} nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    ("bsd-name", "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense-free", "This is free and unencumbered software released into the public domain"),
    ("boost-name", "Distributed under the Boost Software License, Version 1.0"),
    (
        "zlib-grant",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    ("cc0", "To the extent possible under law, {} has waived all copyright and related or neighboring rights to {}"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc0", "Licensed under CC0 1.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved"),
    *((f"spdx-{x}", f"SPDX-License-Identifier: {x}") for x in SPDX),
)
# Rules over the identifiers, in order: licence, pattern, whether it is open.
RULES = (
    ("Apache-2.0", "<apache-(?:grant|name)><apache-use>(?:<apache-copy>)?(?:<apache-see>)?", True),
    ("Apache-2.0", "<apache-(?:grant|name)>", True),
    ("MIT", "<mit-grant>(?:<mit-notice>)?|<mit-name>", True),
    ("ISC", "<isc-grant>", True),
    ("LGPL-2.1-or-later", "<lgpl-terms><lgpl-later>", True),
    ("LGPL", "<lgpl-terms>", True),
    ("AGPL-3.0-or-later", "<agpl-terms>", True),
    ("GPL-3.0-or-later", "<gpl-terms-3>|<gpl-terms><gpl-later-3>", True),
    ("GPL-2.0-or-later", "<gpl-terms-2>|<gpl-terms><gpl-later-2>", True),
    ("GPL-2.0-only", "<gpl-2-only>|<gpl-terms><gpl-only-2>", True),
    ("GPL-3.0-only", "<gpl-3-only>|<gpl-terms><gpl-only-3>", True),
    ("GPL-3.0", "<gpl3-name>", True),
    ("GPL", "<gpl-terms>", True),
    ("CC-BY-NC-4.0", "<cc-by-nc>", False),
    ("CC-BY-SA-4.0", "<cc-by-sa>", True),
    ("CC-BY-4.0", "<cc-by>", True),
    # A copyright line and its "All rights reserved" stand above the conditions of BSD.
    ("BSD-3-Clause", "(?:<reserved>)?<bsd-use>(?:<bsd-source>)?(?:<bsd-binary>)?<bsd-name>", True),
    ("BSD-2-Clause", "(?:<reserved>)?<bsd-use>(?:<bsd-source>)?(?:<bsd-binary>)?", True),
    ("MPL-2.0", "<mpl-form>", True),
    ("Unlicense", "<unlicense-free>", True),
    ("BSL-1.0", "<boost-name>", True),
    ("Zlib", "<zlib-grant>", True),
    ("CC0-1.0", "<cc0>", True),
    *((x, f"<spdx-{x.replace('.', '[.]')}>", True) for x in SPDX),
    ("Proprietary", "<reserved>", False),
)
#: A boundary, twice: sentences side by side each have one of their own.
BREAK = "\n\n"
#: What may stand between two words, the most words of a slot, and a slot.
GAP, SLOT = f"(?: |{BREAK})", 12
NAME = f"[a-z0-9]+(?:{GAP}[a-z0-9]+){{0,{SLOT - 1}}}?"
# The steps of the normalisation: pattern and replacement.
STEPS = (
    ("[.!?;:][\"')\\]]*[\\x20\\x09-\\x0D]", "\x01"),
    ("[\\x0A-\\x0D]", "\x01"),
    ("[^a-z0-9\\x01]+", " "),
    (" ?\\x01[ \\x01]*", BREAK),
)


def _plain(sentence: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+|\{\}", sentence.lower()))


def _triggers(sentences: Sequence[tuple[str, str]]) -> str:
    return "|".join(sorted({max(_plain(text).split(), key=len) for _, text in sentences}))


def _words(plain: str, gap: str = GAP, name: str = NAME) -> str:
    return plain.replace(" ", gap).replace("{}", name)


def _pattern(sentences: Sequence[tuple[str, str]]) -> str:
    """Any of the sentences between boundaries, the longest first."""
    known = sorted({_plain(text) for _, text in sentences}, key=lambda x: (-len(x), x))
    return f"(?:^ ?|\n)({'|'.join(map(_words, known))})(?: ?$|\n)"


def _by_sentence(sentences: Sequence[tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """Codes by sentence, and by pattern for those that have slots."""
    codes = {_plain(known): f"<{name}>" for name, known in sentences}
    open_ = {f"^{_words(known, ' ', '.+')}$": code for known, code in codes.items() if "{}" in known}
    return {known: code for known, code in codes.items() if "{}" not in known}, open_


def sentence_codes(text: Column, sentences: Sequence[tuple[str, str]] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order, each in angle brackets."""
    clean = ascii_lower(text)
    for pattern, to in STEPS:
        clean = F.regexp_replace(clean, pattern, to)
    found = F.regexp_extract_all(clean, F.lit(_pattern(sentences)), F.lit(1))
    whole, slotted = _by_sentence(sentences)
    by_sentence = F.create_map(*[F.lit(x) for pair in whole.items() for x in pair])

    def code(sentence: Column) -> Column:
        one = F.replace(sentence, F.lit(BREAK), F.lit(" "))
        return F.coalesce(F.try_element_at(by_sentence, one), *[F.when(one.rlike(pattern), F.lit(c)) for pattern, c in slotted.items()], F.lit(""))

    codes = F.array_join(F.transform(found, code), "")
    return F.when(text.rlike(f"(?i){_triggers(sentences)}"), codes).otherwise(F.lit(""))


def match_rules(codes: Column, rules: Sequence[tuple[str, str, bool]] = RULES) -> list[tuple[str, bool, Column]]:
    """For each rule its licence, whether it is open, and whether it fits what the
    rules before it have left."""
    out, left = [], codes
    for name, pattern, is_open in rules:
        out.append((name, is_open, left.rlike(pattern)))
        left = F.regexp_replace(left, pattern, ";")
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, sentence_codes, n_sentences (known ones),
    licenses (by rule, comma-separated), restricted (a licence that isn't open)."""
    coded = docs.select(F.col(quoted(id_col)).alias("doc_id"), sentence_codes(F.coalesce(F.col(quoted(text_col)), F.lit(""))).alias("sentence_codes"))
    fits = match_rules(F.col("sentence_codes"))
    names = F.array_distinct(F.filter(F.array(*[F.when(hit, F.lit(name)) for name, _, hit in fits]), lambda x: x.isNotNull()))
    closed = F.lit(False)
    for _, is_open, hit in fits:
        if not is_open:
            closed = closed | hit
    return coded.select(
        "doc_id",
        "sentence_codes",
        F.regexp_count("sentence_codes", F.lit("<")).cast("bigint").alias("n_sentences"),
        F.when(F.col("sentence_codes") == "", F.lit("")).otherwise(F.array_join(names, ",")).alias("licenses"),
        F.when(F.col("sentence_codes") == "", F.lit(False)).otherwise(closed).alias("restricted"),
    )


def op3_license_sentences(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text"))


def _oracle() -> str:
    sql = lambda x: "'" + x.replace("'", "''").replace("\x01", "\\x01") + "'"
    clean = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    for pattern, to in STEPS:
        new = "chr(1)" if to == "\x01" else "chr(10) || chr(10)" if to == BREAK else sql(to)
        clean = f"regexp_replace({clean}, {sql(pattern)}, {new}, 'g')"
    whole, slotted = _by_sentence(SENTENCES)
    one = "replace(x, chr(10) || chr(10), ' ')"
    cases = " ".join([f"WHEN {one} = '{known}' THEN '{code}'" for known, code in whole.items()] + [f"WHEN regexp_matches({one}, '{known}') THEN '{code}'" for known, code in slotted.items()])
    pattern = _pattern(SENTENCES).replace("\n", "\\n")
    left, hits = "codes", []
    for name, rule, is_open in RULES:
        hits.append((name, is_open, f"regexp_matches({left}, '{rule}')"))
        left = f"regexp_replace({left}, '{rule}', ';', 'g')"
    names = ", ".join(f"CASE WHEN {hit} THEN '{name}' END" for name, _, hit in hits)
    order = ", ".join(f"'{x}'" for x in dict.fromkeys(name for name, *_ in RULES))
    closed = " OR ".join(hit for _, is_open, hit in hits if not is_open)
    return f"""
WITH c AS (SELECT doc_id, regexp_extract_all({clean}, '{pattern}', 1) AS s FROM documents),
k AS (SELECT doc_id, coalesce(array_to_string(list_transform(s, lambda x: CASE {cases} ELSE '' END), ''), '') AS codes FROM c),
l AS (SELECT doc_id, codes, [{names}] AS hits, {closed} AS restricted FROM k)
SELECT doc_id, codes AS sentence_codes, CAST(length(codes) - length(replace(codes, '<', '')) AS BIGINT) AS n_sentences,
       coalesce(array_to_string(list_filter([{order}], lambda x: list_contains(hits, x)), ','), '') AS licenses, restricted
FROM l"""


ORACLE = _oracle()
