"""Licence scan: a paragraph classifier in DataFrame functions.

A paragraph is a line. Its features are the words and word pairs it shares
with the licence templates. A multinomial logistic regression with sparse
weights, fitted on templates with words left out and on a bounded sample of
paragraphs of the table, gives each family and "unknown" a probability; a
temperature fitted on rows kept from learning calibrates it. A family counts
as found in a line if it is the most probable class, its probability reaches
``SURE``, and one of its templates has at least ``CONFIRM`` of its words and
pairs there.

Notices over several lines, and several in one line, are found in windows of
words that run over line ends: a window is twice as long as the templates it is
for and they overlap by half, so every notice lies in one. Each template is
judged for itself, against "unknown" only; beside another family it counts if
it also has ``CONFIRM`` of what that family's templates lack. No pair of words
reaches over an empty line.

Paragraphs without any anchor word are not scored: an anchor is a template
word that is not everyday English, and every template has more than
1 - CONFIRM of its features on anchors, so none of them could be confirmed.
Fixed tables are given as text that is read once, when the plan is made.
All scoring is one projection without a shuffle and without Python.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "unknown"
SAMPLE_DOCS = 2000  # documents whose paragraphs are used for learning
SAMPLE_ROWS = 6000  # paragraphs used for learning
SURE, CONFIRM = 0.5, 0.6

# Notices by family, as their licences word them.
TEMPLATES = {
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "cc0-1.0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": ["All rights reserved."],
    "public-domain": ["This work has been released into the public domain.", "This is free and unencumbered software released into the public domain."],
}
# Everyday words that say nothing about a licence.
EVERYDAY = frozenset("a all and any are as been by except for has in into is may not of or that the this to under use used with without you".split())


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


GRAMS = {f: [grams_of(t) for t in ts] for f, ts in TEMPLATES.items()}
VOCABULARY = sorted({g for ts in GRAMS.values() for t in ts for g in t})


def anchors() -> list[str]:
    """Words, the longest of a template first, until they touch more than 1 - CONFIRM of its features."""
    chosen: set[str] = set()
    for t in (t for ts in GRAMS.values() for t in ts):
        left = sorted({w for g in t for w in g.split()} - EVERYDAY - chosen, key=lambda w: (w.isdigit(), -len(w), w))
        while sum(any(w in chosen for w in g.split()) for g in t) <= (1 - CONFIRM) * len(t) + 1e-9:
            chosen.add(left.pop(0))
    return sorted(chosen)


ANCHORS = anchors()
WINDOWS = (16, 48, 160)  # words; the longest template has at most half of the last
ANCHOR = "(?i)(?<![a-z0-9])(" + "|".join(ANCHORS) + ")(?![a-z0-9])"


def strings(xs: list[str]) -> Column:
    return F.split(F.lit("\n".join(xs)), "\n")


def grams(text: Column) -> Column:
    """Distinct words and word pairs of a paragraph that the templates have."""
    w = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_intersect(F.concat(w, pairs), strings(VOCABULARY))


def rules() -> list[dict]:
    """Each template: family, words of its window, features, and for each other family the features that one lacks."""
    every = {f: {g for t in ts for g in t} for f, ts in GRAMS.items()}
    out = []
    for f, ts in TEMPLATES.items():
        for t in ts:
            g = grams_of(t)
            size = min(w for w in WINDOWS if w >= 2 * len(words_of(t)))
            out.append({"f": f, "s": size, "g": g, "d": {o: [x for x in g if x not in have] for o, have in every.items() if o != f}})
    return out


RULE = "array<struct<f:string,s:int,g:array<string>,d:map<string,array<string>>>>"


def held(have: Column, features: Column) -> Column:
    return F.size(F.array_intersect(have, features)) / F.size(features)


def family_match(have: Column, families: list[str]) -> Column:
    """For each family the largest share of one of its templates' features (0 for one without templates)."""
    known = F.from_json(F.lit(json.dumps([GRAMS.get(f, []) for f in families])), "array<array<array<string>>>")
    return F.transform(known, lambda ts: F.coalesce(F.array_max(F.transform(ts, lambda t: held(have, t))), F.lit(0.0)))


@dataclass
class Model:
    """Class names, intercepts, weights by feature, and the temperature."""

    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float


def _paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def training_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(family, grams) of templates, also with one word left out, and of sampled paragraphs."""
    spark = docs.sparkSession
    rows = []
    for f, ts in TEMPLATES.items():
        for t in ts:
            w = words_of(t)
            rows += [(f, " ".join(w))] * 3 + [(f, " ".join(w[:i] + w[i + 1 :])) for i in range(len(w)) if len(w) > 3]
    known = spark.createDataFrame(rows, "family string, text string")
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    drawn = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    lines = drawn.select(F.explode(_paragraphs(F.col(text_col))).alias("text")).filter(F.length(F.trim("text")) > 0)
    lines = lines.distinct().orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS)
    # the family that comes first of those with the largest share
    names = list(TEMPLATES)

    def label(match: Column) -> Column:
        best = F.array_max(match)
        return F.when(best >= 0.8, F.get(strings(names), (F.array_position(match, best) - 1).cast("int"))).when(best < 0.5, F.lit(UNKNOWN))

    seen = lines.select(grams(F.col("text")).alias("grams"))
    seen = seen.select(F.transform(F.array(family_match(F.col("grams"), names)), label)[0].alias("family"), "grams").filter("family is not null")
    return known.select("family", grams(F.col("text")).alias("grams")).unionByName(seen)


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """Fits weights and temperature on the training rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    classes = [UNKNOWN, *TEMPLATES]
    label = F.coalesce(*[F.when(F.col("family") == c, F.lit(float(i))) for i, c in enumerate(classes)])
    rows = training_rows(docs, text_col).withColumn("label", label)
    # the unknown class needs rows even where the sample has none
    rows = rows.unionByName(docs.sparkSession.createDataFrame([(UNKNOWN, [], 0.0)], "family string, grams array<string>, label double"))
    rows = rows.withColumn("kept", F.pmod(F.xxhash64("grams", "label"), F.lit(5)) == 0)
    vector = CountVectorizerModel.from_vocabulary(VOCABULARY, "grams", "features").setBinary(True)
    ready = vector.transform(rows).select("label", "features", "kept", "grams").coalesce(1).cache()
    fit = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.2, maxIter=60).fit(ready)
    m = fit.coefficientMatrix.toArray()
    bias = [float(x) for x in fit.interceptVector.toArray()]
    got = m.shape[0]  # classes beyond the largest label seen do not occur
    weights = {g: [float(x) for x in m[:, j]] for j, g in enumerate(VOCABULARY) if abs(m[:, j]).max() > 1e-9}
    held = ready.filter("kept").select("label", "grams").limit(SAMPLE_ROWS).collect()
    ready.unpersist()
    best = (math.inf, 1.0)
    for t in [0.25 * 1.25**i for i in range(14)]:
        loss = 0.0
        for r in held:
            z = [(b + sum(weights[g][c] for g in r.grams if g in weights)) / t for c, b in enumerate(bias)]
            top = max(z)
            loss += top + math.log(sum(math.exp(x - top) for x in z)) - z[int(r.label)]
        best = min(best, (loss, t))
    return Model(classes[:got], bias, weights, best[1])


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_paragraphs``, ``n_licences``, ``families`` and ``licences``.

    ``licences`` is an array of (line from 0, family, probability, match) of
    the notices in order, each with the line it begins in; ``families`` their
    distinct families, sorted, joined by commas. A null or empty text is one empty paragraph
    without licence. Columns of ``docs`` with these names are replaced. Equal
    probabilities go to the family that comes first in the model.
    """
    table = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    known = strings(list(model.weights))

    def logits(have: Column) -> Column:
        add = lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b)
        total = F.aggregate(F.array_intersect(have, known), F.array(*map(F.lit, model.bias)), add)
        return F.transform(total, lambda x: x / F.lit(model.temperature))

    # one step a transform: an expression used twice inside a lambda would run twice
    def featured(line: Column) -> Column:
        return F.struct(line["no"].alias("line"), grams(line["text"]).alias("grams"))

    def compared(s: Column) -> Column:
        return F.struct(s["line"].alias("line"), s["grams"].alias("grams"), family_match(s["grams"], model.classes).alias("match"))

    def scored(s: Column) -> Column:
        return F.struct(s["line"].alias("line"), logits(s["grams"]).alias("z"), s["match"].alias("match"))

    def decided(s: Column) -> Column:
        top = F.array_max(s["z"])
        at = F.array_position(s["z"], top).cast("int")
        total = F.aggregate(s["z"], F.lit(0.0), lambda a, z: a + F.exp(z - top))
        return F.struct(
            s["line"].alias("line"),
            F.element_at(F.array(*map(F.lit, model.classes)), at).alias("family"),
            F.round(1 / total, 6).alias("probability"),
            F.round(F.element_at(s["match"], at), 6).alias("match"),
        )

    # windows of a text: its words with their lines, an empty line as a word of its own
    def numbered(line: Column, no: Column) -> Column:
        w = F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda x: x != "")
        return F.transform(F.when(F.size(w) > 0, w).otherwise(F.array(F.lit("\n"))), lambda x: F.struct(x.alias("w"), no.alias("no")))

    def stream(text: Column) -> Column:
        w = F.flatten(F.transform(_paragraphs(text), numbered))
        return F.struct(w.alias("words"), grams(text).alias("grams"))

    def possible(s: Column) -> Column:
        # a template that the whole text lacks is in no window of it
        rule = F.from_json(F.lit(json.dumps(rules())), RULE)
        return F.struct(s["words"].alias("words"), F.filter(rule, lambda t: held(s["grams"], t["g"]) >= CONFIRM).alias("rules"))

    def windows(s: Column) -> Column:
        def cut(size: int) -> Column:
            at = F.sequence(F.lit(0), F.greatest(F.size(s["words"]) - size // 2 - 1, F.lit(0)), F.lit(size // 2))
            own = F.transform(
                at,
                lambda i: F.struct(F.lit(size).alias("s"), i.alias("at"), F.slice(s["words"], i + 1, F.lit(size)).alias("words"), s["rules"].alias("rules")),
            )
            return F.when(F.exists(s["rules"], lambda t: t["s"] == size), own).otherwise(F.filter(own, lambda x: F.lit(False)))

        return F.concat(*[cut(w) for w in WINDOWS])

    def window_grams(x: Column) -> Column:
        have = grams(F.array_join(F.transform(x["words"], lambda w: F.when(w["w"] == "\n", F.lit("zz0zz")).otherwise(w["w"])), " "))
        return F.struct(x["s"].alias("s"), x["at"].alias("at"), x["words"].alias("words"), have.alias("grams"), x["rules"].alias("rules"))

    def matched(x: Column) -> Column:
        full = F.filter(x["rules"], lambda t: held(x["grams"], t["g"]) >= CONFIRM)
        return F.struct(x["s"].alias("s"), x["at"].alias("at"), x["words"].alias("words"), x["grams"].alias("grams"), full.alias("rules"))

    def distinct_families(x: Column) -> Column:
        def stands(t: Column) -> Column:
            return F.forall(x["rules"], lambda o: (o["f"] == t["f"]) | F.coalesce(held(x["grams"], F.element_at(t["d"], o["f"])) >= CONFIRM, F.lit(False)))

        own = F.filter(x["rules"], lambda t: (t["s"] == x["s"]) & stands(t))
        z = F.when(F.size(own) > 0, logits(x["grams"]))
        return F.struct(x["at"].alias("at"), x["words"].alias("words"), x["grams"].alias("grams"), own.alias("rules"), z.alias("z"))

    def placed(x: Column) -> Column:
        classes = F.array(*map(F.lit, model.classes))

        def place(t: Column) -> Column:
            pair = F.transform(
                x["words"],
                lambda w, i: F.when(F.array_contains(t["g"], F.concat_ws(" ", w["w"], F.get(x["words"], i + 1)["w"])), F.struct(i.alias("i"), w["no"].alias("no"))),
            )
            hit = F.filter(pair, lambda p: p.isNotNull())
            return F.struct(
                t["f"].alias("family"),
                (x["at"] + F.array_min(hit)["i"]).alias("first"),
                (x["at"] + F.array_max(hit)["i"]).alias("last"),
                F.array_min(hit)["no"].alias("line"),
                F.array_max(hit)["no"].alias("end"),
                F.round(1 / (1 + F.exp(F.get(x["z"], F.lit(0)) - F.get(x["z"], (F.array_position(classes, t["f"]) - 1).cast("int")))), 6).alias("probability"),
                F.round(held(x["grams"], t["g"]), 6).alias("match"),
            )

        return F.filter(F.transform(x["rules"], place), lambda h: (h["probability"] >= SURE) & h["first"].isNotNull())

    def joined(found: Column) -> Column:
        # the same notice in overlapping windows, or by two of its templates, once
        def add(acc: Column, h: Column) -> Column:
            before = F.get(acc, F.size(acc) - 1)
            same = F.coalesce((before["family"] == h["family"]) & (h["first"] <= before["last"]), F.lit(False))
            both = F.struct(
                h["family"].alias("family"),
                before["first"].alias("first"),
                F.greatest(before["last"], h["last"]).alias("last"),
                before["line"].alias("line"),
                F.greatest(before["end"], h["end"]).alias("end"),
                F.greatest(before["probability"], h["probability"]).alias("probability"),
                F.greatest(before["match"], h["match"]).alias("match"),
            )
            return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(h)))

        ordered = F.array_sort(found)
        return F.aggregate(ordered, F.filter(ordered, lambda h: F.lit(False)), add)

    def in_windows(text: Column) -> Column:
        one = F.transform(F.transform(F.array(text), stream), possible)
        cut = F.flatten(F.transform(F.filter(one, lambda s: F.size(s["rules"]) > 0), windows))
        full = F.filter(F.transform(F.transform(cut, window_grams), matched), lambda x: F.size(x["rules"]) > 0)
        return F.transform(F.array(F.flatten(F.transform(F.transform(full, distinct_families), placed))), joined)[0]

    def merged(s: Column) -> Column:
        # what a window has found stands for a line's own result of that family
        more = F.filter(s["lines"], lambda h: ~F.exists(s["windows"], lambda w: (w["family"] == h["family"]) & h["line"].between(w["line"], w["end"])))
        own = F.transform(s["windows"], lambda w: F.struct(*[w[c].alias(c) for c in ("line", "family", "probability", "match")]))
        return F.array_sort(F.concat(more, own))

    lines = F.transform(_paragraphs(F.col(text_col)), lambda x, i: F.struct(i.alias("no"), x.alias("text")))
    anchored = F.filter(lines, lambda s: s["text"].rlike(ANCHOR))
    near = F.filter(F.transform(F.transform(anchored, featured), compared), lambda s: F.exists(s["match"], lambda m: m >= CONFIRM))
    hits = F.transform(F.transform(near, scored), decided)
    sure = F.filter(hits, lambda h: (h["family"] != UNKNOWN) & (h["probability"] >= SURE) & (h["match"] >= CONFIRM))
    # texts without an anchor word at all skip the work on lines
    none = F.filter(sure, lambda h: F.lit(False))
    base = docs.drop("n_paragraphs", "n_licences", "families", "licences")
    pair = F.struct(sure.alias("lines"), in_windows(F.col(text_col)).alias("windows"))
    found = F.when(F.col(text_col).rlike(ANCHOR), F.transform(F.array(pair), merged)[0]).otherwise(none)
    out = base.withColumn("licences", found)
    return out.select(
        *base.columns,
        F.size(_paragraphs(F.col(text_col))).cast("bigint").alias("n_paragraphs"),
        F.size("licences").cast("bigint").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda h: h["family"]))), ",").alias("families"),
        "licences",
    )
