"""Licence scans: paragraphs classified by sparse word n-gram logistic regression.

The model is fitted here on labelled paragraphs made from fixed notices and from prose that only talks
about licences; it has a class for "unknown", and a threshold calibrated on held-out paragraphs. Scanning
uses DataFrame functions only: the n-grams of a paragraph meet the weight table, whose size is that of the
training vocabulary, and a predicted family must be confirmed by comparison with its notices.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Standard notices of the families (fixed texts).
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "MIT License Copyright (c)",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "Apache License Version 2.0, January 2004",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPLv3.",
        "Distributed under the terms of the GNU GPL version 3 or later.",
    ],
    "gpl-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPLv2.",
        "This file is licensed under the GNU GPL version 2.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the LGPL.",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPLv3.",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 2-Clause License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal, dedicated to the public domain.", "This work has been dedicated to the public domain under CC0."],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.",
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "proprietary": ["All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. All rights reserved."],
}
# Prose that mentions licences without granting one.
OTHER = [
    "She lost her driving license on the way to the station.",
    "The license plate of the car was covered in mud.",
    "A fishing license costs more this year than the last.",
    "The committee discussed which license the project should choose.",
    "He asked for permission to leave the room before the end.",
    "The copyright office moved to a new building in spring.",
    "There is no warranty on a used bicycle from the market.",
    "Poetic license lets the author bend the facts of history.",
    "Restaurants need a liquor license before they may open.",
    "Permission denied while opening the file.",
    "The museum holds the copyright of the photographs in the book.",
    "The bar kept its license after the hearing.",
    "Under the terms of the agreement the house was sold in May.",
    "The public library is free and open to the general public.",
    "Version 3 of the report was published in March.",
    "Software costs and documentation were part of the budget.",
    "The lawyer compared the two licenses and advised the company to wait.",
    "Our guide explains how to choose a license for a new project and what a warranty covers.",
    "Copyright law differs from country to country, as the lecture showed.",
    "You may not redistribute the exam papers before the end of term.",
    "The Apache helicopters flew over the valley twice in the afternoon.",
    "Students at MIT built the robot in two weeks and published the design.",
    "Mozilla released a new version of its browser with better protection.",
    "The foundation publishes a report on free software in schools each year.",
    "With the permission of the owner the path leads through the garden.",
    "The software is provided with a printed manual and a cable.",
    "All rights and duties of the tenant are listed in the second part.",
    "The public domain of the village includes the meadow by the river.",
    "Creative work needs time, and the commons need care, she wrote.",
    "The terms of the loan were published by the bank in the spring.",
]
# Every notice holds one of these.
ANCHOR = r"(?i)licen[sc]|copyright|all rights reserved|permission|warrant|redistribut|public domain|creative commons|spdx|mozilla public|mozilla org|the mpl|gpl|proprietary"
# The same with any signs between its words, as a line break and a comment mark may come there.
WRAPPED = ANCHOR.replace(" ", "[^a-z0-9]+")
# A word mark of a comment at the beginning of a line; signs are no words.
MARK = r"(?i)^\s*(?:dnl|rem)\s"
WORD = r"[a-z0-9]+"
CONFIRM = 0.6
# Words of the windows that are classified. One begins every quarter of its width, so that a notice of up to three quarters of it lies whole in one.
WIDTHS = [12, 16, 24, 36, 48]


def grams(text: str) -> set[str]:
    """Words and pairs of words of a paragraph, lower-cased."""
    words = re.findall(WORD, text.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def labelled_paragraphs(seed: int = 5) -> list[tuple[str, str]]:
    """(family, paragraph): notices and prose, alone, inside other words and with words lost."""
    rng = np.random.Generator(np.random.PCG64(seed))
    filler = " ".join(OTHER).lower().replace(".", "").split()
    out = []
    for family, texts in [*NOTICES.items(), (UNKNOWN, OTHER)]:
        for text in texts:
            out += [(family, text)] * 2
            for _ in range(10 if family == UNKNOWN else 14):
                words = text.split()
                if len(words) > 5:
                    words = [w for w in words if rng.random() > 0.08]
                lead = rng.choice(filler, rng.integers(0, 8)).tolist()
                tail = rng.choice(filler, rng.integers(0, 8)).tolist()
                out.append((family, " ".join([*lead, *words, *tail])))
    out += [(UNKNOWN, " ".join(rng.choice(filler, rng.integers(3, 25)))) for _ in range(300)]
    return out


@functools.lru_cache(1)
def trained() -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """(families, weights of each n-gram, intercepts, least probability) of the softmax regression.

    Every fourth paragraph is held out; the least probability is the lowest at which no held-out
    paragraph gets a wrong family, 0.5 at least.
    """
    families = [*NOTICES, UNKNOWN]
    rows = labelled_paragraphs()
    vocabulary = sorted({g for _, t in rows for g in grams(t)})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, (_, text) in enumerate(rows):
        found = [place[g] for g in grams(text)]
        x[i, found] = 1 / np.sqrt(len(found))
    y = np.eye(len(families))[[families.index(f) for f, _ in rows]]
    held = np.arange(len(rows)) % 4 == 3
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    for _ in range(300):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - y[~held]) / (~held).sum()
        w -= 60 * (x[~held].T @ error + 1e-6 * w)
        b -= 60 * error.sum(0)
    z = x[held] @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    wrong = (p.argmax(1) != y[held].argmax(1)) & (p.argmax(1) != len(families) - 1)
    least = max(0.5, float(p.max(1)[wrong].max()) if wrong.any() else 0.5)
    kept = {g: w[i] for g, i in place.items() if np.abs(w[i]).max() > 1e-3}
    return families, kept, b, min(least, 0.95)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def grams_of(words: Column) -> Column:
    """As grams(), of an array of words."""

    def both(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.array_distinct(F.concat(w, F.filter(pairs, lambda g: g.isNotNull())))

    return let(words, both)


def spoken(lines: Column) -> Column:
    """(paragraph, before, line, after) of the lines in which words of a licence begin; before and after are the words around in its block.

    A block is a run of lines with a letter or digit, of any length. before and after have at most the widest window.
    """
    reach = WIDTHS[-1]
    none = F.expr("cast(array() as array<string>)")
    blank = lambda x: ~x.rlike(r"[\p{L}\p{N}]")
    unmarked = lambda x: F.regexp_replace(x, MARK, " ")
    plain = lambda x: words_of(unmarked(x))
    # each of these lines has a word or ends a block, so reach of them hold all words that a window can have; others, of letters without words, do neither
    telling = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: blank(y["x"]) | F.lower(unmarked(y["x"])).rlike(WORD))

    def of(kept: Column) -> Column:
        def before(k: Column) -> Column:
            above = F.slice(kept, F.greatest(k - reach + 1, F.lit(1)), F.least(k, F.lit(reach)))["x"]
            last = lambda w: F.slice(w, F.greatest(F.size(w) - reach + 1, F.lit(1)), reach)
            return F.aggregate(above, none, lambda acc, x: F.when(blank(x), none).otherwise(let(F.concat(acc, plain(x)), last)))

        def after(k: Column) -> Column:
            below = F.slice(kept, k + 2, reach)["x"]
            start = F.struct(F.lit(False).alias("over"), none.alias("words"))
            step = lambda acc, x: F.struct((acc["over"] | blank(x)).alias("over"), F.when(acc["over"] | blank(x), acc["words"]).otherwise(F.slice(F.concat(acc["words"], plain(x)), 1, reach)).alias("words"))
            return F.aggregate(below, start, step)["words"]

        def speaks(x: Column, k: Column) -> Column:
            return F.concat_ws("\n", x, F.slice(kept, k + 2, 2)["x"]).rlike(r"\A[^\n]*?(?:" + WRAPPED + ")")

        numbered = F.filter(F.transform(kept, lambda y, k: F.struct(k.alias("k"), y["i"].alias("i"), y["x"].alias("x"), speaks(y["x"], k).alias("yes"))), lambda y: y["yes"])
        return F.transform(
            numbered, lambda y: F.struct(y["i"].alias("paragraph"), before(y["k"]).alias("before"), words_of(y["x"]).alias("line"), after(y["k"]).alias("after"))
        )

    return let(telling, of)


def windows_of(every: Column, first: Column, n: Column, notices: Column) -> Column:
    """(anchor, words) of the windows around each of the n words from place first on at which words of a licence begin.

    Only those that hold CONFIRM of a notice's n-grams: others cannot be confirmed.
    """
    reach = WIDTHS[-1]
    share = lambda g, notice: F.size(F.array_intersect(g, notice)) / F.size(notice)
    three = lambda p: F.concat_ws(" ", F.slice(every, p + 1, 3))
    anchors = F.filter(F.sequence(first, first + n - 1), lambda p: three(p).rlike(r"\A[a-z0-9]*?(?:" + ANCHOR + ")"))

    def grid(p: Column, width: int) -> Column:
        step = width // 4
        number = F.sequence(F.greatest(F.floor((p - width) / step) + 1, F.lit(0)).cast("int"), F.floor(p / step).cast("int"))
        return F.transform(number, lambda q: F.struct((q * step).alias("start"), F.lit(width).alias("width")))

    def at(p: Column) -> Column:
        low = F.greatest(p - reach, F.lit(0))
        region = F.slice(every, low + 1, 2 * reach)
        near = let(grams_of(region), lambda g: F.filter(notices, lambda x: share(g, x) >= CONFIRM))
        begins = F.flatten(F.array(*[grid(p, w) for w in WIDTHS]))
        window = lambda b: F.struct(p.alias("anchor"), F.slice(every, b["start"] + 1, b["width"]).alias("words"))
        holds = lambda y, some: let(grams_of(y["words"]), lambda g: F.exists(some, lambda x: share(g, x) >= CONFIRM))
        return let(near, lambda some: F.when(F.size(some) > 0, F.filter(F.transform(begins, window), lambda y: holds(y, some))))

    found = F.flatten(F.filter(F.transform(anchors, at), lambda x: x.isNotNull()))
    return F.when(n > 0, found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity) for each paragraph that speaks of a licence.

    A paragraph is a line in which words of a licence begin; paragraph is its number from 0. Judged are the
    line and, around each such word, windows of the block of lines around it, since notices are wrapped; lines
    without a word of a-z or digits, however many, lie inside a block and add no words. A
    family is right where the model's probability reaches the calibrated threshold and similarity, the
    largest share of a family notice's n-grams that is there, is CONFIRM or more; at each word the most
    similar one counts. A line has one row for each family, or one with "unknown". Null and empty texts
    have no paragraphs; each repeated row is scanned; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    families, weights, intercept, least = trained()
    texts = [(f, sorted(grams(t))) for f, ts in NOTICES.items() for t in ts]
    # one row for each n-gram of the training vocabulary or of a notice: a fixed size
    zero = np.zeros(len(families))
    rows = [(g, [float(v) for v in weights.get(g, zero)], [int(g in t) for _, t in texts]) for g in sorted(set(weights) | {g for _, t in texts for g in t})]
    model = spark.createDataFrame(rows, "gram string, w array<double>, held array<int>")
    notices = F.array(*[F.array(*[F.lit(g) for g in t]) for _, t in texts])
    lines = (
        docs.where(F.col(text).rlike(WRAPPED))
        .select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.split(text, "\n").alias("lines"))
        .select("row", "doc_id", F.explode(spoken(F.col("lines"))).alias("x"))
        .select("row", "doc_id", "x.*")
    )
    whole = F.struct(F.lit(-1).alias("anchor"), F.col("line").alias("words"))
    around = windows_of(F.concat("before", "line", "after"), F.size("before"), F.size("line"), notices)
    pieces = F.concat(F.array(whole), F.coalesce(around, F.expr("cast(array() as array<struct<anchor:int,words:array<string>>>)")))
    known = lines.select("row", "doc_id", "paragraph", F.posexplode(pieces).alias("piece", "y")).select("row", "doc_id", "paragraph", "piece", "y.anchor", grams_of(F.col("y.words")).alias("grams"))
    # outer: a paragraph without any known n-gram keeps the intercepts
    each = known.select("row", "doc_id", "paragraph", "piece", "anchor", F.size("grams").alias("n"), F.explode_outer("grams").alias("gram"))
    met = each.join(F.broadcast(model), "gram", "left")
    logits = [(F.lit(float(b)) + F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) / F.sqrt(F.greatest(F.first("n"), F.lit(1)))).alias(f"z{i}") for i, b in enumerate(intercept)]
    shares = [(F.coalesce(F.sum(F.col("held")[i]), F.lit(0)) / len(t)).alias(f"s{i}") for i, (_, t) in enumerate(texts)]
    scored = met.groupBy("row", "paragraph", "piece").agg(F.first("doc_id").alias("doc_id"), F.first("anchor").alias("anchor"), *logits, *shares)
    z = F.array(*[F.col(f"z{i}") for i in range(len(families))])
    top = F.array_max(z)
    total = F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
    alike = [F.greatest(F.lit(0.0), *[F.col(f"s{i}") for i, (f, _) in enumerate(texts) if f == family], F.lit(0.0)) for family in families]
    guess = scored.select(
        "row", "doc_id", "paragraph", "anchor", (1 / total).alias("probability"), F.element_at(F.lit(families), F.array_position(z, top).cast("int")).alias("guess"),
        F.element_at(F.array(*alike), F.array_position(z, top).cast("int")).alias("similarity"),
    )
    sure = (F.col("probability") >= least) & (F.col("similarity") >= CONFIRM) & (F.col("guess") != UNKNOWN)
    judged = F.struct("similarity", "probability", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "anchor")
    listed = guess.groupBy("row", "paragraph").agg(F.first("doc_id").alias("doc_id"), F.collect_list(judged).alias("all"))
    right = F.filter("all", lambda x: x["family"] != UNKNOWN)
    best = lambda xs: F.array_max(xs)
    at = lambda a: best(F.filter(right, lambda x: (x["anchor"] == a) | (x["anchor"] == -1)))
    # the line as a whole counts by itself only if no window is right
    windowed = F.exists(right, lambda x: x["anchor"] >= 0)
    chosen = F.transform(F.array_distinct(F.transform(F.filter(right, lambda x: ~windowed | (x["anchor"] >= 0)), lambda x: x["anchor"])), at)
    one = lambda f: best(F.filter(F.col("chosen"), lambda x: x["family"] == f))
    single = F.transform(F.array_distinct(F.transform("chosen", lambda x: x["family"])), one)
    unsure = F.filter("all", lambda x: x["anchor"] == -1)
    out = listed.withColumn("chosen", chosen).select("doc_id", "paragraph", F.explode(F.when(F.size("chosen") > 0, single).otherwise(unsure)).alias("x"))
    return out.select("doc_id", "paragraph", "x.family", "x.probability", "x.similarity")
