"""Licence families of paragraphs, in DataFrame expressions only.

A sparse logistic regression over word n-grams, trained on notice templates, gives
each paragraph a family or ``unknown``; the probability of the unknown class is
calibrated on cut and embedded notices that the weights were not fitted on. A
prediction counts once a template of its family confirms it by comparison. A notice
may be one line or wrapped over several, which are judged together as well.

Only n-grams with a cue (a word such as licence, copyright, permission) are
features, so a paragraph without a cue has no feature and is unknown by the bias:
such texts are passed over without being cut up.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from .common import unused
from .rules import let

# The cues, and for each family the notices that name it.
CUES = ["licen", "copyright", "permission", "warrant", "redistribut", "spdx", "creative commons", "public domain", "unlicense", "cc by", "cc-by", "cc0", "gpl", "rights reserved", "proprietary", "confidential"]
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the Apache License 2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 3 or later.",
        "Released under the GPLv3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU GPL version 2.",
        "Released under the GPLv2 license.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is released under the LGPL license, version 2.1.",
        "SPDX-License-Identifier: LGPL-3.0",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL license.",
        "SPDX-License-Identifier: AGPL-3.0",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Licensed under the BSD license.",
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights; CC0 public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "Released under the Unlicense license.",
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ],
    "Proprietary": [
        "All rights reserved. Copyright by the authors.",
        "This document is proprietary and confidential; all rights reserved, no part may be copied without permission.",
        "Proprietary license. Unauthorised copying is prohibited. Confidential.",
    ],
}
# Sentences with cues that state no licence.
ORDINARY = [
    "He lost his driving licence after the accident and asked permission to walk home.",
    "The license plate of the car was covered with mud.",
    "A fishing licence costs more than last year in most counties.",
    "They debated copyright law at the university for two hours.",
    "The warranty of the washing machine ends next month.",
    "She gave permission for the children to stay.",
    "A search warrant was issued by the judge on Monday.",
    "The plan would redistribute income from the rich to the poor.",
    "The pub lost its license to sell beer and wine.",
    "Confidential sources told the paper about the meeting.",
    "The proprietary drug was taken off the market.",
    "Licensed electricians must check the wiring before use.",
    "The photograph is said to be in the public domain of debate.",
    "The copyright page of a book names the publisher.",
    "Doctors are licensed by the state for five years.",
]
# Notices of licences that are none of the families.
FOREIGN = [
    "Licensed under the Northwind Commercial License, Version 3.0.",
    "Use of this product is governed by the Contoso End User License Agreement.",
    "Released under the Foo Public License, version 4.",
    "This program is licensed under the terms of the Vendor Community License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    "Licensed under the Academic Free License version 2.1.",
    "This file is licensed under the Eclipse Public License 1.0.",
    "SPDX-License-Identifier: LicenseRef-Internal",
    "Made available under the Open Data Commons License.",
]
UNKNOWN = "unknown"
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _tokens(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _ngrams(tokens: list[str], cues: list[str]) -> set[str]:
    """Word 1- to 3-grams of a paragraph in which a cue stands."""
    if not any(c in " ".join(tokens) for c in cues):
        return set()
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


@dataclass(frozen=True)
class Classifier:
    """Weights of the features by family (``unknown`` last), the bias, what is added
    to the unknown class by calibration, and the templates' word pairs."""

    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    offset: float


def _softmax(z: list[float]) -> list[float]:
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def _scores(grams: set[str], weights: dict[str, list[float]], bias: list[float]) -> list[float]:
    z = list(bias)
    for g in grams:
        if g in weights:
            z = [a + b for a, b in zip(z, weights[g])]
    return z


@lru_cache(maxsize=4)
def train(seed: int = 1, rounds: int = 25, rate: float = 0.3, sparsity: float = 0.002) -> Classifier:
    """Fit on variants of the templates and of the ordinary sentences: notices whole,
    with words left out, and among other words. Every third template is kept from a
    first fit for the calibration, the second fit has all. Weights are shrunk by
    ``sparsity`` each round (a proximal step of the L1 penalty), those that reach zero
    are dropped."""
    draw = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    filler = [w for s in ORDINARY for w in _tokens(s)]
    variants = []
    for k, f in enumerate(families):
        for i, text in enumerate(TEMPLATES.get(f, ORDINARY + FOREIGN)):
            words = _tokens(text)
            for v in range(12):
                kept = words if v % 3 == 0 else [w for w in words if draw.random() > 0.1]
                if v % 2 and f != UNKNOWN:
                    kept = draw.choices(filler, k=draw.randrange(12)) + kept + draw.choices(filler, k=draw.randrange(12))
                variants.append((_ngrams(kept, CUES), k, i % 3 == 2))
    weights, bias = _fit([x for x in variants if not x[2]], len(families), draw, rounds, rate, sparsity)
    held = [x for x in variants if x[2]]
    # The unknown class gets the offset at which templates that had no part in the fit
    # are least surprised, among those that leave a paragraph without features unknown.
    options = [x / 4 for x in range(-6, 13)]
    loss = lambda o: -sum(math.log(max(_softmax([*(z := _scores(g, weights, bias))[:-1], z[-1] + o])[k], 1e-9)) for g, k, _ in held)
    offset = min(options, key=loss)
    weights, bias = _fit(variants, len(families), draw, rounds, rate, sparsity)
    return Classifier(families, weights, bias, offset)


def _fit(variants: list, classes: int, draw: random.Random, rounds: int, rate: float, sparsity: float) -> tuple[dict[str, list[float]], list[float]]:
    """Weights by n-gram, and the bias, which is not fitted: a paragraph without a
    feature is unknown."""
    fitted = list(variants)
    weights: dict[str, list[float]] = {}
    frequent = Counter(g for grams, _, _ in fitted for g in grams)
    usable = {g for g, n in frequent.items() if n >= 3}
    bias = [0.0] * (classes - 1) + [2.0]
    for _ in range(rounds):
        draw.shuffle(fitted)
        for grams, k, _ in fitted:
            active = [g for g in grams if g in usable]
            p = _softmax(_scores(set(active), weights, bias))
            pace = rate / max(1, len(active)) ** 0.5
            step = [pace * ((i == k) - x) for i, x in enumerate(p)]
            for g in active:
                weights[g] = [a + b for a, b in zip(weights.get(g, [0.0] * classes), step)]
        shrink = lambda x: math.copysign(max(abs(x) - sparsity, 0.0), x)
        weights = {g: s for g, w in weights.items() if any(s := [shrink(x) for x in w])}
    return weights, bias


def constant(value, kind: str) -> Column:
    """A constant as one expression, which the optimizer folds to a literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def word_pairs(text: str) -> list[str]:
    """Word pairs of a template; of a single word, the word."""
    words = _tokens(text)
    return sorted({" ".join(p) for p in zip(words, words[1:])} or set(words))


@lru_cache(maxsize=1)
def template_pairs() -> dict[str, list[tuple[list[str], list[str]]]]:
    """Of each family's templates: all word pairs, and those of them that neither
    another family's template, nor a foreign notice, nor an ordinary sentence has."""
    pairs = {f: [word_pairs(t) for t in texts] for f, texts in TEMPLATES.items()}
    common = {p for t in ORDINARY + FOREIGN for p in word_pairs(t)}
    elsewhere = {f: common.union(*[p for g in pairs if g != f for p in pairs[g]]) for f in pairs}
    return {f: [(p, [x for x in p if x not in elsewhere[f]]) for p in pairs[f]] for f in pairs}


def confirmation(tokens: Column, families: list[str]) -> Column:
    """For each family, the highest share of a template's word pairs that stand in the
    paragraph, among templates half of whose own pairs (if any) stand there too."""

    def shares(own: Column) -> Column:
        best = []
        for f in families:
            found = constant([{"p": p, "o": o} for p, o in template_pairs()[f]], "array<struct<p:array<string>,o:array<string>>>")
            best.append(F.array_max(F.transform(found, lambda t: F.when(2 * F.size(F.array_intersect(own, t["o"])) >= F.size(t["o"]), F.size(F.array_intersect(own, t["p"])) / F.size(t["p"])).otherwise(0.0))))
        return F.array(*best)

    return let(_column_ngrams(tokens, 2), shares)


def _column_ngrams(tokens: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def classify(paragraph: Column, model: Classifier, least: float) -> Column:
    """struct<family, probability, confirmed, share> of a paragraph that holds a cue.
    A family is confirmed if it is likelier than all else together and by a template."""
    known = model.families[:-1]
    names = constant(model.families, "array<string>")
    table = constant([{"g": g, "w": w} for g, w in sorted(model.weights.items())], "array<struct<g:string,w:array<double>>>")
    vocabulary = constant(sorted(model.weights), "array<string>")
    bias = constant([b + (model.offset if i == len(known) else 0.0) for i, b in enumerate(model.bias)], "array<double>")

    def judge(tokens: Column) -> Column:
        grams = F.concat(*[_column_ngrams(tokens, n) for n in (1, 2, 3)])
        hits = F.array_intersect(grams, vocabulary)

        def predict(z: Column) -> Column:
            top = F.array_max(z)
            total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
            at = F.array_position(z, top).cast("int")
            family = F.element_at(names, at)
            alike = F.when(at <= len(known), F.element_at(confirmation(tokens, known), F.least(at, F.lit(len(known)))))
            return F.struct(family.alias("family"), (F.lit(1.0) / total).alias("probability"), F.coalesce((alike >= least) & (total < 2.0), F.lit(False)).alias("confirmed"), F.coalesce(alike, F.lit(0.0)).alias("share"))

        def add(h: Column) -> Column:
            rows = F.filter(table, lambda v: F.array_contains(h, v["g"]))
            return F.aggregate(rows, bias, lambda z, v: F.zip_with(z, v["w"], lambda a, b: a + b))

        return let(let(hits, add), predict)

    return let(F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), F.lit(0)), judge)


def _longest() -> int:
    """Words of the longest template."""
    return max(len(_tokens(t)) for texts in TEMPLATES.values() for t in texts)


def _alike(least: float) -> list[str]:
    """Pairs of families ("one/other") of which a notice of one confirms the other."""
    pairs = {f: [{*zip(w := _tokens(t), w[1:])} or {*w} for t in texts] for f, texts in TEMPLATES.items()}
    close = lambda f, g: any(len(x & y) >= least * len(y) for x in pairs[f] for y in pairs[g])
    return [f"{f}/{g}" for f in pairs for g in pairs if f != g and (close(f, g) or close(g, f))]


def has_cue(x: Column) -> Column:
    out = F.lit(False)
    for c in CUES:
        out = out | F.contains(x, F.lit(c))
    return out


def notices(text: Column, model: Classifier, least: float) -> Column:
    """struct<sure: array<struct<family, probability>>, unknown: int> of a text.

    Each line with a cue is judged alone. A line that holds a whole template, or no
    word, ends a paragraph. Within a paragraph each line is also judged with the one,
    two and more lines that follow, until they hold as many words as the longest
    template: one of these windows is the notice that begins in the line, however it
    is wrapped. Part of a notice may look like a notice of an alike family: of
    overlapping ones of alike families the one that holds more of a template counts."""
    room = _longest()
    alike = constant(_alike(least), "array<string>")
    whole = lambda p: F.coalesce(p["note"]["share"] >= 1, F.lit(False))
    words = lambda line: F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0))
    found = lambda i, last, note: F.struct(i.alias("i"), last.alias("last"), note.alias("note"))

    def windows(lines: Column, i: Column) -> Column:
        def more(acc: Column, p: Column) -> Column:
            go_on = acc["open"] & (acc["words"] < room) & (F.size(p["words"]) > 0) & ~whole(p)
            size, one = F.when(go_on, F.size(p["words"])).otherwise(0), F.when(go_on, 1).otherwise(0)
            return F.struct((acc["words"] + size).alias("words"), (acc["lines"] + one).alias("lines"), go_on.alias("open"))

        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"), F.lit(True).alias("open"))
        extra = F.aggregate(F.slice(lines, i + 2, F.lit(room)), start, more, lambda acc: acc["lines"])

        def judge(k: Column) -> Column:
            joined = F.array_join(F.flatten(F.transform(F.slice(lines, i + 1, k + 1), lambda p: p["words"])), " ")
            return let(joined, lambda x: F.when(has_cue(x), found(i, i + k, classify(x, model, least))))

        own = lines[i]
        each = let(extra, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), judge)))
        return F.coalesce(F.when((F.size(own["words"]) > 0) & ~whole(own), each), F.array())

    def choose(lines: Column) -> Column:
        alone = F.filter(F.transform(lines, lambda p, i: found(i, i, p["note"])), lambda x: x["note"].isNotNull())
        wide = F.filter(F.flatten(F.transform(lines, lambda p, i: windows(lines, i))), lambda x: F.coalesce(x["note"]["confirmed"], F.lit(False)))
        return let(F.struct(alone.alias("alone"), wide.alias("wide")), count)

    def count(x: Column) -> Column:
        def better(a: Column, b: Column) -> Column:
            both = F.concat(a["note"]["family"], F.lit("/"), b["note"]["family"])
            return (b["i"] <= a["last"]) & (b["last"] >= a["i"]) & (b["note"]["share"] > a["note"]["share"]) & F.array_contains(alike, both)

        sure = F.concat(F.filter(x["alone"], lambda a: a["note"]["confirmed"]), x["wide"])
        kept = let(sure, lambda all_: F.transform(F.filter(all_, lambda a: ~F.exists(all_, lambda b: better(a, b))), lambda a: a["note"]))
        open_ = F.filter(x["alone"], lambda a: ~a["note"]["confirmed"] & ~F.exists(x["wide"], lambda b: (b["i"] <= a["i"]) & (b["last"] >= a["i"])))
        return F.struct(kept.alias("sure"), F.size(open_).alias("unknown"))

    judged = F.transform(F.split(text, "\n"), lambda p: F.struct(words(p).alias("words"), F.when(has_cue(F.lower(p)), classify(p, model, least)).alias("note")))
    return let(judged, choose)


def scan(df: DataFrame, text: str = "text", least: float = 0.6, seed: int = 1) -> DataFrame:
    """``df`` with ``licenses`` (the families of its confirmed notices, sorted),
    ``probability`` (the highest among them, null if none) and ``unknown_notices``
    (lines with a cue that are unknown or not confirmed, alone and with neighbours).

    Notices are lines of the text, or several lines of a paragraph if they are
    wrapped. A null text, an empty one and one without a cue have no licences and
    no notices. ``least``: the share of a template that must stand in the notice.
    Whole texts are scanned, very long ones too; columns of ``df`` with these names
    are replaced, others stay; repeated rows get the same; an empty table gives an
    empty one.
    """
    model = train(seed)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # A cue of two words may be wrapped too.
    wrapped = "|".join(c.replace(" ", "[^a-z0-9]+") for c in CUES if " " in c)
    any_cue = has_cue(F.lower(t)) | F.lower(t).rlike(wrapped)
    out = df.drop("licenses", "probability", "unknown_notices")
    (found,) = unused(out, "_found")
    out = out.withColumn(found, F.when(any_cue, notices(t, model, least)))
    families = F.array_sort(F.array_distinct(F.transform(f"{found}.sure", lambda x: x["family"])))
    out = out.withColumn("licenses", F.coalesce(families, F.array().cast("array<string>")))
    out = out.withColumn("probability", F.array_max(F.transform(f"{found}.sure", lambda x: x["probability"])))
    return out.withColumn("unknown_notices", F.coalesce(F.col(f"{found}.unknown"), F.lit(0)).cast("int")).drop(found)
