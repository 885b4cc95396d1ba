"""Licences of documents: TF-IDF cosine to templates, then directory inheritance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import KEY, aside, join_small, row_key
from ledgerloom.session import stage

#: Licence names and the notices they are recognised by.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Longer passages; of the longest licences, what they open with.
PASSAGES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND "
     "CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: Redistributions of source code must retain "
     "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in "
     "binary form must reproduce the above copyright notice, this list of conditions and the following "
     "disclaimer in the documentation and/or other materials provided with the distribution. Neither the "
     "name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software "
     "Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
     "document, but changing it is not allowed."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the Software), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be "
     "included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
     "copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: More families, so that none is taken for a licence that is worded like it.
PASSAGES += (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software "
     "Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
     "document, but changing it is not allowed."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse "
     "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
     "License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software "
     "Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
     "document, but changing it is not allowed."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
     "all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of "
     "the GNU Lesser General Public License as published by the Free Software Foundation; either version "
     "2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free "
     "Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
     "document, but changing it is not allowed."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software "
     "Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license "
     "document, but changing it is not allowed."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to "
     "copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
     "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: What a notice of a family must say, and what tells that it is another one.
TELLING = {
    "AGPL-3.0": (("affero", "3"), ("lesser",)),
    "GPL-2.0": (("2",), ("lesser", "library", "affero", "3")),
    "GPL-3.0": (("3",), ("lesser", "affero")),
    "LGPL-2.1": (("2", "1"), ("affero",)),
    "LGPL-3.0": (("lesser", "3"), ("affero",)),
}
_TOLD = sorted({t for sides in TELLING.values() for terms_ in sides for t in terms_})
_SPDX = r"(?i)SPDX-License-Identifier:\s*([a-z0-9.+-]+)"
_HEADING = r"(?im)^[^a-z0-9\n]*(?:the )?(mit) license(?: \(mit\))?[^a-z0-9\n]*$"
#: A line carries the licence of the template it is most like, from this cosine on.
LEAST_COSINE = 0.75
_SEPARATORS = "[^a-z0-9]+"
_LICENCE_FILE = "(?i)^(license|licence|copying|unlicense)([.-].*)?$"


def terms(text: Column) -> Column:
    """Lower-case ASCII letters and digits in runs."""
    return F.filter(F.split(F.lower(text), _SEPARATORS), lambda t: t != "")


def _told() -> Column:
    """Those terms of a group of rows that tell families apart, at most all of them."""
    return F.collect_set(F.when(F.col("term").isin(_TOLD), F.col("term")))


def _is_told(told: str) -> Column:
    """Whether what is told fits the licence: cosine alone hardly sees one word."""
    fits = F.lit(True)
    for name, (must, never) in TELLING.items():
        wanted, other = (F.array(*map(F.lit, ts)).cast("array<string>") for ts in (must, never))
        right = (F.size(F.array_except(wanted, told)) == 0) & ~F.arrays_overlap(told, other)
        fits = F.when(F.col("license") == name, right).otherwise(fits)
    return fits


def _frequencies(texts: DataFrame) -> DataFrame:
    """In how many texts each term occurs: all terms of all texts."""
    held = texts.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return held.groupBy("term").agg(F.count("*").alias("df"))


class _Rarity:
    """What makes the weight of a term: one count of all texts, read wherever it is needed."""

    def __init__(self, texts: DataFrame):
        self.texts = texts.count()
        self.frequencies = stage(_frequencies(texts), "frequencies")

    def weighted(self, counted: DataFrame) -> DataFrame:
        """Add ``df`` and ``weight``, the count of a term times its inverse document frequency."""
        wanted = stage(counted.select("term").distinct(), "wanted")
        known = stage(join_small(self.frequencies, wanted, "term", "left_semi"), "known")
        rarity = F.log((1 + F.lit(self.texts)) / (1 + F.coalesce("df", F.lit(0)))) + 1
        return join_small(counted, known, "term").withColumn("weight", F.col("n") * rarity)

    def patterns(self, notices: Sequence[tuple[str, str]], least: float) -> DataFrame:
        """The terms of numbered notices with their weights, and whether a term is ``needed``.

        A text without any needed term of a notice has at most its other terms, whose
        weight is too small for the cosine.  The commonest terms are the ones not needed.
        """
        listed = self.frequencies.sparkSession.createDataFrame(
            [(i, *n) for i, n in enumerate(notices)], "number int, license string, notice string"
        )
        split = listed.withColumn("_terms", terms(F.col("notice")))
        counted = (
            split.select("number", "license", F.size("_terms").alias("_long"), F.explode("_terms").alias("term"))
            .groupBy("number", "license", "_long", "term").agg(F.count("*").alias("n"))
        )
        square = F.col("weight") * F.col("weight")
        of_notice = Window.partitionBy("number")
        spent = F.sum(square).over(of_notice.orderBy(F.desc(F.coalesce("df", F.lit(0))), "term"))
        enough = least**2 * F.sum(square).over(of_notice) * (1 - 1e-9)
        return stage(
            self.weighted(counted).select(
                "number", "license", "_long", "term", F.col("weight").alias("_w"),
                F.sqrt(F.sum(square).over(of_notice)).alias("_size"), (spent >= enough).alias("needed"),
            ),
            "patterns",
        )


def _needed(*patterns: DataFrame) -> Column:
    """The needed terms of the patterns: no more than the notices have."""
    listed = {row["term"] for p in patterns for row in p.where("needed").select("term").collect()}
    return F.array(*map(F.lit, sorted(listed))).cast("array<string>")


def line_licenses(
    texts: DataFrame, patterns: DataFrame, rarity: _Rarity, least: float, key: Sequence[str]
) -> DataFrame:
    """(key..., license, similarity) of the texts with a line like a template.

    Only lines with a needed term are weighed; none that could qualify is left out.
    """
    lines = stage(
        texts.select(*key, F.posexplode(F.split("text", "\n")).alias("line", "text"))
        .withColumn("terms", terms(F.col("text")))
        .where(F.arrays_overlap("terms", _needed(patterns)))
        .select(*key, "line", "terms"),
        "lines",
    )
    words = lines.select(*key, "line", F.explode("terms").alias("term"))
    counts = words.groupBy(*key, "line", "term").agg(F.count("*").alias("n"))
    weighed = stage(rarity.weighted(counts), "weights")
    square = F.sum(F.col("weight") * F.col("weight"))
    lengths = weighed.groupBy(*key, "line").agg(F.sqrt(square).alias("_length"), _told().alias("_told"))
    products = (
        join_small(weighed, patterns, "term", "inner")
        .groupBy(*key, "line", "number", "license", "_size")
        .agg(F.sum(F.col("weight") * F.col("_w")).alias("_dot"))
        .join(lengths, [*key, "line"])
        .withColumn("similarity", F.round(F.col("_dot") / (F.col("_length") * F.col("_size")), 6))
    )
    return products.where((F.col("similarity") >= least) & _is_told("_told")).select(
        *key, "license", "similarity"
    )


def named_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]], text_col: str, key: Sequence[str]
) -> DataFrame:
    """(key..., license, similarity) of texts that name a template's licence: SPDX or a heading."""
    names = docs.sparkSession.createDataFrame(
        sorted({(license, license.lower()) for license, _ in templates}), "license string, _name string"
    )
    found = F.concat(
        *(F.regexp_extract_all(F.lower(text_col), F.lit(p), F.lit(1)) for p in (_SPDX, _HEADING))
    )
    bare = F.transform(found, lambda n: F.regexp_replace(n, r"(-only|-or-later|\+)?\.?$", ""))
    name = F.explode(bare).alias("_name")
    return docs.where(F.contains(F.lower(text_col), F.lit("license"))).select(*key, name).join(
        F.broadcast(names), "_name"
    ).select(*key, "license", F.lit(1.0).alias("similarity"))


def passage_licenses(
    texts: DataFrame, patterns: DataFrame, rarity: _Rarity, least: float, key: Sequence[str]
) -> DataFrame:
    """(key..., license, similarity) of texts with a run of terms like a passage, across lines.

    The runs are as long as the passage and start with a term of it.  The cosine of a
    run is at most the share of the passage's length that the terms they have in common
    make up.  So texts with too few of its terms go first; of the others, each block of
    twice the passage's length, in which a run that starts in its first half also ends;
    and only what is left is cut into runs.  A long text gives two words a word before that.
    """
    whole = (least * F.col("_size")) ** 2 * (1 - 1e-9)
    share = F.sum(F.col("_w") * F.col("_w")).alias("_held")
    passage = ["number", "_long", "_size"]
    bags = texts.select(*key, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    likely = stage(
        join_small(bags, patterns, "term", "inner")
        .groupBy(*key, *passage).agg(share).where(F.col("_held") >= whole).select(*key, *passage),
        "likely",
    )
    block = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("terms") - 1) / F.col("_long")).cast("int")),
        lambda b: F.struct(
            b.alias("block"),
            F.slice("terms", b * F.col("_long") + 1, 2 * F.col("_long") - 1).alias("words"),
        ),
    )
    blocks = (
        join_small(texts.select(*key, terms(F.col("text")).alias("terms")), likely, key, "inner")
        .select(*key, *passage, F.explode(block).alias("_b"))
        .select(*key, *passage, "_b.block", "_b.words")
    )
    blocks = stage(blocks, "blocks")
    close = (
        join_small(
            blocks.select(*key, "number", "block", F.explode(F.array_distinct("words")).alias("term")),
            patterns, ["number", "term"], "inner",
        )
        .groupBy(*key, *passage, "block").agg(share).where(F.col("_held") >= whole)
        .select(*key, "number", "block")
    )
    own = patterns.groupBy("number").agg(F.collect_set("term").alias("_own"))
    starts = F.filter(
        F.sequence(F.lit(1), F.least("_long", F.size("words"))),
        lambda i: F.array_contains("_own", F.element_at("words", i)),
    )
    runs = (
        join_small(blocks, stage(close, "close"), [*key, "number", "block"], "left_semi")
        .dropDuplicates([*key, "number", "block"]).join(F.broadcast(own), "number")
        .select(*key, "number", "block", "_long", "words", F.explode(starts).alias("start"))
        .select(*key, "number", "block", "start",
                F.explode(F.slice("words", F.col("start"), F.col("_long"))).alias("term"))
        .groupBy(*key, "number", "block", "start", "term").agg(F.count("*").alias("n"))
    )
    weighed = join_small(rarity.weighted(stage(runs, "runs")), patterns.drop("needed"), ["number", "term"])
    return (
        weighed.groupBy(*key, "number", "block", "start").agg(
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"),
            F.sum(F.col("weight") * F.col("_w")).alias("_dot"),
            F.max("_size").alias("_size"), F.max("license").alias("license"), _told().alias("_told"),
        )
        .withColumn("similarity", F.round(F.col("_dot") / (F.col("_length") * F.col("_size")), 6))
        .where((F.col("similarity") >= least) & _is_told("_told")).select(*key, "license", "similarity")
    )


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    least: float = LEAST_COSINE,
    text_col: str = "text",
    path_col: str = "path",
    passages: Sequence[tuple[str, str]] = PASSAGES,
) -> DataFrame:
    """Add ``license``, ``similarity``, and ``license_dir`` where it is inherited.

    Any line of a text can carry a notice; so can any run of terms as long as a notice
    or one of the ``passages``, within a line or across lines; and an SPDX identifier or
    a line that only names the MIT licence counts as similarity 1.  Families worded alike
    (GPL, LGPL, AGPL and their versions) must also hold the words that tell them apart
    (``TELLING``), or nothing is reported.  A document without one of its own takes
    that of the licence file in the nearest directory above it (its own directory
    first), found by joining paths: directories are few next to documents, and each
    is resolved once.  Several licence files in a directory: the most similar
    notice, then the first name.  Texts without either have nulls, as do null and
    empty texts outside such directories; a null path inherits nothing.  Rows alike
    in text and path share the result; an empty table gives no rows.  Input columns
    with the names of results are replaced.
    """
    docs, back = aside(
        docs, ["license", "similarity", "license_dir"], ["_dir", "_license", "_from", *KEY],
        [text_col, path_col],
    )
    path = F.col(path_col)
    keyed = docs.select("*", *row_key(text_col, path_col), F.regexp_extract(path, "^(.*)/", 1).alias("_dir"))
    texts = keyed.select(*KEY, F.col(text_col).alias("text")).where("text is not null")
    rarity = _Rarity(texts)
    lines = rarity.patterns(templates, least)
    runs = rarity.patterns([*templates, *passages], least)
    some = F.arrays_overlap(terms(F.col("text")), _needed(lines, runs))
    texts = stage(texts.where(some), "texts")
    found = (
        line_licenses(texts, lines, rarity, least, KEY)
        .unionByName(named_licenses(keyed, templates, text_col, KEY))
        .unionByName(passage_licenses(texts, runs, rarity, least, KEY))
    )
    likest = F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("_b")
    own = stage(
        found.groupBy(*KEY).agg(likest)
        .select(*KEY, F.col("_b.license").alias("license"), (-F.col("_b.s")).alias("similarity")),
        "own",
    )
    marked = join_small(keyed, own, KEY)

    name = F.regexp_extract(path, "([^/]*)$", 1)
    files = keyed.where(F.regexp_like(name, F.lit(_LICENCE_FILE))).select(*KEY, "_dir").distinct()
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("_b")
    grants = stage(
        files.join(own, KEY).groupBy("_dir").agg(best)
        .select(F.col("_dir").alias("_above"), F.col("_b.license").alias("_license")),
        "grants",
    )
    parts = F.split("_dir", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    nearest = F.max(F.struct(F.length("_above").alias("n"), "_above", "_license")).alias("_n")
    resolved = stage(
        join_small(
            keyed.where(path.isNotNull()).select("_dir").distinct()
            .select("_dir", F.explode(above).alias("_above")),
            grants, "_above", "inner",
        )
        .groupBy("_dir").agg(nearest)
        .select("_dir", F.col("_n._license").alias("_license"), F.col("_n._above").alias("_from")),
        "directories",
    )
    inherited = F.col("license").isNull()
    return join_small(marked, resolved, "_dir").select(
        *back,
        F.coalesce("license", "_license").alias("license"), "similarity",
        F.when(inherited, F.col("_from")).alias("license_dir"),
    )
