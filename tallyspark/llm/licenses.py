"""Licence scans: a paragraph classifier over sparse word n-grams, in SQL expressions alone.

A paragraph is a line of a text, or a run of consecutive lines: wrapped notices are classified as a whole too. Lines without any
entry word are left out before the model sees them: words chosen so that what all others could add up to stays below what the
model asks of a licence (`entry_words`). A multinomial logistic regression over word 1- to 3-grams, trained here on worded
variants of the families' notices and on paragraphs sampled from the corpus, gives a probability to each family, to "unknown"
(a licence, but none of these) and to "none" (ordinary text). A temperature fitted on other wordings, which the model has not
seen, calibrates the probabilities; a best family below SURE becomes unknown. A family counts as confirmed if enough of the
paragraph's word pairs also stand in one of its notices.

Training is on the driver: the variants are fixed text, and of the sampled paragraphs, a bounded number chosen by hash, only the
model's n-grams come there. The model is a table of at most VOCABULARY n-grams that goes to every task.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, table

#: Wordings of each family's notice.
NOTICES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL v3."],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GNU GPL v2."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights; released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
}
#: Licence text of no family above, and ordinary text that holds a cue. CUES only keep lines out of the sample of ordinary text.
UNKNOWN = ["Licensed under the terms of the vendor agreement.", "Licensed under the Example Community License, version 5.", "This work is licensed under our own terms of use.", "All rights reserved.", "Copyright 2019 the authors. All rights reserved.", "Released under a proprietary license.", "SPDX-License-Identifier: LicenseRef-custom", "Use of this file is subject to a commercial license.", "Distributed under the Open Widget License.", "Licensed for internal use only."]
ORDINARY = ["He lost his driving license last year.", "She asked for permission to leave the room.", "The license plate was covered in mud.", "They have a warrant for the search.", "Copyright law is taught in the second term.", "The doctor's licence was renewed in spring.", "No permission was needed to enter the park.", "The warranty had run out by then.", "He was licensed to fly at the age of twenty.", "The public domain of the city is large."]
#: Other wordings, which calibrate the probabilities and are never learnt from.
OTHER_WORDINGS = {
    "mit": ["Distributed under the MIT license, see the file LICENSE.", "The code is available under the terms of the MIT License."],
    "apache-2.0": ["This software is available under the Apache License 2.0.", "Distributed under the terms of the Apache License, Version 2.0."],
    "gpl-3.0": ["Distributed under the terms of the GNU General Public License version 3 or later.", "It is free software under the GNU GPL version 3."],
    "gpl-2.0": ["Distributed under the terms of the GNU General Public License version 2 only.", "It is free software under the GNU GPL version 2."],
    "lgpl": ["Distributed under the terms of the GNU Lesser General Public License.", "It is licensed under the GNU LGPL, version 2.1 or later."],
    "agpl-3.0": ["Distributed under the terms of the GNU Affero General Public License.", "You may use it under the GNU AGPL version 3."],
    "bsd": ["Distributed under the BSD license, see LICENSE.", "It is released under a 3-clause BSD license."],
    "mpl-2.0": ["Distributed under the terms of the Mozilla Public License 2.0.", "The files are subject to the Mozilla Public License."],
    "cc-by-nc-4.0": ["The text is available under the Creative Commons Attribution-NonCommercial license.", "Shared under CC BY-NC 4.0 International."],
    "cc-by-sa-4.0": ["The text is available under the Creative Commons Attribution-ShareAlike license.", "Shared under CC BY-SA 4.0 International."],
    "cc-by-4.0": ["The text is available under the Creative Commons Attribution 4.0 license.", "Shared under CC BY 4.0 International."],
    "public-domain": ["This work has been released into the public domain.", "All rights waived under CC0 1.0 Universal."],
    "isc": ["Distributed under the ISC license, see LICENSE.", "The code is available under the terms of the ISC License."],
    "unknown": ["Licensed under the terms of the customer agreement.", "All rights are reserved by the publisher.", "Distributed under a commercial license of the vendor.", "This file is licensed under the Sample Share License."],
    "none": ["The driver showed his licence to the officer.", "They asked for permission and were granted a day off.", "The version that he told was not the same.", "She works in a public library in the city.", "The terms of the sale were read out.", "It is distributed among all of them at once."],
}
OPENINGS = ("", "This file is part of the project. ", "Copyright (c) 2021 the authors. ", "Note: ", "The contents are ")
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "rights reserved", "warrant", "public domain", "free software", "spdx")
WORD = r"[^a-z0-9.+]+"
#: n-grams of up to so many words, n-grams in the model, paragraphs sampled for training; a family needs such a probability, and such a share of word pairs.
GRAMS, VOCABULARY, SAMPLE, SURE, ALIKE = 3, 4096, 2000, 0.5, 0.5


def words_of(line: str) -> list[str]:
    cleaned = "".join(c if c.isascii() and (c.isalnum() or c in ".+") else " " for c in line.lower())
    return [w for w in (x.strip(".") for x in cleaned.split()) if w]


def grams_of(line: str, most: int = GRAMS) -> set[str]:
    w = words_of(line)
    return {" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)}


def variants() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(text, class) to learn from, and held out: the openings that the former do not have."""
    given = [(t, k) for k, ts in [*NOTICES.items(), ("unknown", UNKNOWN), ("none", ORDINARY)] for t in ts]
    learn, held = [], []
    for i, (t, k) in enumerate(given):
        for j, o in enumerate(OPENINGS):
            w = t.split()
            for v in (t, t.upper(), t.rstrip("."), " ".join(w[: max(5, len(w) * 3 // 4)])):
                (held if (i + j) % 4 == 3 and j else learn).append((o + v, k))
    return learn, held


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(ordinary: tuple[str, ...] = ()) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Classes, n-grams, weights (n-grams by classes) and constants, divided by the fitted temperature; ordinary: texts."""
    return _fit(tuple(frozenset(grams_of(t)) for t in ordinary))


@cache
def vocabulary() -> list[str]:
    """The n-grams that a model may hold: those of at least two of the texts that are learnt from, the most frequent ones."""
    seen: dict[str, int] = {}
    for t, _ in variants()[0]:
        for g in grams_of(t):
            seen[g] = seen.get(g, 0) + 1
    return sorted(sorted((g for g in seen if seen[g] >= 2), key=lambda g: (-seen[g], g))[:VOCABULARY])


@cache
def _fit(ordinary: tuple[frozenset[str], ...]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    learn, held = variants()
    held = held + [(t, k) for k, ts in OTHER_WORDINGS.items() for t in ts for _ in range(len(held) // 40)]
    classes = [*NOTICES, "unknown", "none"]
    sets = [*(grams_of(t) for t, _ in learn), *ordinary]
    learn = learn + [("", "none")] * len(ordinary)
    grams = vocabulary()
    at = {g: i for i, g in enumerate(grams)}

    def matrix(some: list[set[str] | frozenset[str]]) -> np.ndarray:
        x = np.zeros((len(some), len(grams)), np.float32)
        for i, s in enumerate(some):
            x[i, [at[g] for g in s if g in at]] = 1
        return x

    # texts that the model cannot tell apart are one row, with the weight of all
    rows: dict[tuple[frozenset[str], str], int] = {}
    for one, (_, k) in zip(sets, learn, strict=True):
        key = frozenset(g for g in one if g in at), k
        rows[key] = rows.get(key, 0) + 1
    x, y = matrix([s for s, _ in rows]), np.eye(len(classes), dtype=np.float32)[[classes.index(k) for _, k in rows]]
    count = np.array([*rows.values()], np.float32)
    balance = count / (y * count[:, None]).sum(0).clip(1)[y.argmax(1)]
    balance = (balance / balance.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((len(grams), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    for _ in range(400):
        d = (softmax(x @ w + b) - y) * balance
        w -= 4.0 * (x.T @ d + 1e-4 * w)
        w = np.sign(w) * np.maximum(0, np.abs(w) - 4e-5)  # an absolute penalty keeps the model sparse
        b -= 4.0 * d.sum(0)
    hx, hy = matrix([grams_of(t) for t, _ in held]) @ w + b, [classes.index(k) for _, k in held]
    cost = lambda t: -np.log(softmax(hx / t)[range(len(hy)), hy].clip(1e-9)).mean()
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=cost)
    kept = np.flatnonzero(np.abs(w).max(1) > 1e-4)
    return classes, [grams[i] for i in kept], (w[kept] / heat).astype(float), (b / heat).astype(float)


def entry_words(classes: list[str], names: list[str], weights: np.ndarray, constants: np.ndarray, ordinary: tuple[str, ...] = ()) -> list[str]:
    """Words of which a line must hold one for the model to find a licence in it.

    Words common in ordinary text are left out of them, as long as all n-grams of such words together could not lift any class
    above "none". If the constants alone do not favour "none", every word of the model is an entry word."""
    none = classes.index("none")
    gains = np.delete(weights - weights[:, [none]], none, 1).clip(0)
    room = constants[none] - np.delete(constants, none) - 0.01
    seen: dict[str, int] = {}
    for t in ordinary:
        for w in set(words_of(t)):
            seen[w] = seen.get(w, 0) + 1
    of = [set(g.split(" ")) for g in names]
    entry = set().union(*of)
    for w in sorted(entry, key=lambda w: (-seen.get(w, 0), w)):
        rest = entry - {w}
        if w in seen and (gains[[not (o & rest) for o in of]].sum(0) < room).all():
            entry = rest
    return sorted(entry)


def like_a_notice(own: set[str], n_pairs: int) -> bool:
    """Whether a paragraph of so many word pairs, own among them, shares enough of them with a known licence text."""
    given = ({g for g in grams_of(t, 2) if " " in g} for ts in [*NOTICES.values(), UNKNOWN] for t in ts)
    return any(len(own & p) >= ALIKE * max(1, min(n_pairs, len(p))) for p in given)


def has_cue(text: Column) -> Column:
    out = text.contains(CUES[0])
    for c in CUES[1:]:
        out = out | text.contains(c)
    return out


def words(line: Column) -> Column:
    """The words of a line, as words_of gives them."""
    parts = F.split(F.regexp_replace(F.lower(line), WORD, " "), " ")
    return F.filter(F.transform(parts, lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def grams(w: Column, least: int, most: int) -> Column:
    """Distinct runs of least to most words."""
    runs = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(n) for n in range(least, most + 1)]))


def inlined(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def sampled(docs: DataFrame, n: int = SAMPLE) -> list[frozenset[str]]:
    """What ordinary text looks like here: for about n documents, those of the lowest hashes of text, one whole paragraph each, as
    the model's n-grams and words in it.

    The threshold comes from the number of documents, so about n short rows reach the driver; equal paragraphs, which have equal
    hashes, are one, and 2 * n rows at most, of the lowest hashes, however often texts are copied. Paragraphs with a cue, or like
    the notices, are left out."""
    total = docs.count()
    least = max(-(1 << 63), (1 << 64) * min(n, total) // max(total, 1) - (1 << 63) - 1)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 20)
    line = F.array_min(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("line"))))["line"]
    some = docs.select("text").filter(F.xxhash64("text") <= F.lit(least)).select(line.alias("line")).filter(F.col("line").isNotNull() & ~has_cue(F.lower("line")))
    some = some.distinct().orderBy(F.xxhash64("line"), "line").limit(2 * n)
    known = vocabulary()
    known = [*known, *sorted({w for g in known for w in g.split(" ")} - {*known})]
    table = F.array(*[F.lit(g) for g in known])
    some = some.select(words(F.col("line")).alias("w")).select(F.array_intersect(grams(F.col("w"), 1, GRAMS), table).alias("own"), F.size(grams(F.col("w"), 2, 2)).alias("n_pairs"))
    rows = [(frozenset(r["own"]), r["n_pairs"]) for r in some.collect()]
    return sorted((own for own, n_pairs in rows if not like_a_notice({g for g in own if g.count(" ") == 1}, n_pairs)), key=sorted)


FOUND = "array<struct<paragraph:int,last:int,family:string,probability:double,similarity:double,confirmed:boolean,text:string>>"


def license_paragraphs(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text) to one row a document: doc_id, found: array of struct(paragraph, last, family, probability, similarity,
    confirmed, text), the paragraphs that are licences, in order.

    paragraph and last count lines from 0. A run of consecutive lines with entry words is a paragraph of its own: if it is of a
    family and no line in it of another one, it is reported in place of its lines, provided that two of these at least are
    licence text or none has a family by itself. family may be "unknown", which nothing
    confirms. Null and empty texts have none; repeated rows are documents of their own; null doc_ids stay; other columns are
    ignored; an empty table gives an empty one."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ordinary = sampled(docs, sample)
    classes, names, weights, constants = _fit(tuple(ordinary))
    entry = F.array(*[F.lit(w) for w in entry_words(classes, names, weights, constants, tuple(" ".join(g for g in own if " " not in g) for own in ordinary))])
    model = inlined(spark, [{"gram": g, "w": [round(float(x), 6) for x in w]} for g, w in zip(names, weights, strict=True)], "gram: string, w: array<double>")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("paragraph"), x.alias("text"))), lambda p: F.arrays_overlap(words(p["text"]), entry))
    rows = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), lines.alias("lines")), "cues")
    cued = rows.filter(F.size("lines") > 0).select("uid", F.posexplode("lines").alias("i", "line")).select("uid", "line.*", (F.col("line.paragraph") - F.col("i")).alias("run"))
    cued = cued.withColumn("last", F.col("paragraph"))
    runs = cued.groupBy("uid", "run").agg(F.min("paragraph").alias("paragraph"), F.max("paragraph").alias("last"), F.sort_array(F.collect_list(F.struct("paragraph", "text"))).alias("parts")).filter(F.col("last") > F.col("paragraph"))
    runs = runs.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), "\n")).drop("parts")
    cued = stored(cued.unionByName(runs).withColumn("words", words(F.col("text"))), "paragraphs")
    # scores: a row for each n-gram that the model knows; the constants are there even without any
    hits = cued.select("uid", "paragraph", "last", F.explode(grams(F.col("words"), 1, GRAMS)).alias("gram")).join(F.broadcast(model), "gram")
    sums = hits.groupBy("uid", "paragraph", "last").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(classes))])
    scored = cued.join(sums, ["uid", "paragraph", "last"], "left")
    logits = F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) + float(constants[i]) for i in range(len(classes))])
    scored = scored.withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    scored = scored.withColumn("e", F.transform("logits", lambda x: F.exp(x - F.col("top")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    best = F.get(F.array(*[F.lit(c) for c in classes]), F.array_position("logits", F.col("top")).cast("int") - 1)
    scored = scored.withColumn("best", best).withColumn("probability", 1 / F.col("total"))
    scored = scored.filter(F.col("best") != "none")
    scored = scored.withColumn("family", F.when(F.col("probability") >= SURE, F.col("best")).otherwise(F.lit("unknown")))
    notices = inlined(spark, [{"family": k, "pairs": [sorted(g for g in grams_of(t, 2) if " " in g) for t in ts]} for k, ts in NOTICES.items()], "family: string, pairs: array<array<string>>")
    scored = scored.withColumn("own", grams(F.col("words"), 2, 2)).join(F.broadcast(notices), "family", "left")
    shared = lambda p: F.size(F.array_intersect("own", p)) / F.greatest(F.lit(1), F.least(F.size("own"), F.size(p)))
    alike = F.coalesce(F.array_max(F.transform("pairs", shared)), F.lit(0.0))
    scored = scored.withColumn("similarity", F.round(alike, 6)).withColumn("probability", F.round("probability", 6))
    # of a run and its lines: the run if it has a family that none of its lines contradicts, and two lines at least, or none with a family
    sure = F.when(F.col("family") != "unknown", F.col("family"))
    row = F.struct("paragraph", "last", "family", "probability", "similarity", (F.col("similarity") >= ALIKE).alias("confirmed"), "text")
    whole = F.col("last") > F.col("paragraph")
    each = scored.groupBy("uid", "run").agg(F.max(F.when(whole, sure)).alias("of_run"), F.collect_set(F.when(~whole, sure)).alias("of_lines"), F.collect_list(F.when(whole, row)).alias("in_one"), F.collect_list(F.when(~whole, row)).alias("line_by_line"))
    one = F.col("of_run").isNotNull() & (F.size(F.array_except("of_lines", F.array("of_run"))) == 0) & ((F.size("line_by_line") > 1) | (F.size("of_lines") == 0))
    found = each.groupBy("uid").agg(F.sort_array(F.flatten(F.collect_list(F.when(one, F.col("in_one")).otherwise(F.col("line_by_line"))))).alias("found"))
    return rows.join(found, "uid", "left").select("doc_id", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence paragraphs of all documents: how many, how many confirmed, and their families."""
    found = license_paragraphs(table(spark, sf_dir, "documents"))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    confirmed = F.filter("found", lambda p: p["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda p: p["family"]))), ",")
    spans = F.array_join(F.transform("found", lambda p: F.concat_ws(":", p["paragraph"].cast("string"), p["last"].cast("string"), p["family"], p["probability"].cast("string"), p["confirmed"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_license"), count(lambda p: p["confirmed"]).alias("n_confirmed"), count(lambda p: p["family"] == "unknown").alias("n_unknown"), families.alias("families"), spans.alias("paragraphs"))
