"""Licence families of paragraphs by sparse n-gram logistic regression, confirmed by template comparison.

A paragraph that holds an anchor word is classified by a multinomial logistic regression over its distinct word n-grams
(one to three words), with a class for *unknown* and a temperature fitted on findings the weights have not seen.  A
prediction is confirmed when at least 0.8 of the five-word shingles of one of the family's templates stand in the
paragraph (a template of fewer words is one shingle).  The classifier is trained on the driver, from the templates below and seeded variations of them; it never
looks at the corpus, and its size is fixed.

Every paragraph is classified.  Those that the model gives a family are returned, and those with an anchor word whatever
their class.  Each feature of the model holds a word that is not a function word, so a paragraph without any word that
speaks for a family (``telling``) is unknown for certain, by the biases, and is settled as soon as it is cut into words.

The main path is DataFrame code in the JVM: one scan that cuts every text into paragraphs and words, one join of the
paragraphs that are not settled with the model's table (a few thousand rows, sent to all executors) and one grouping.

Edge cases: null and empty texts have no paragraph; wrapped lines are joined unless they end a sentence; an unknown
paragraph without an anchor word has no row; repeated rows are classified each; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
SHINGLE = 5
SIMILARITY = 0.8

# Parts of words that mark a paragraph as one about licences; it has a row whatever its class.
ANCHORS = [*"licen copyright permission warrant redistribut public domain rights spdx creative commons gnu mozilla apache gpl bsd mpl- cc-by cc0 eupl wtfpl altered".split(), "cc by"]

# Notices of each family, as projects write them: headers, single paragraphs of the full texts, short forms.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2 or later.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/ under the Mozilla Public License.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Released under CC BY 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, into the public domain.",
    ],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "Artistic-2.0": ["You may use and distribute it under the terms of the Artistic License 2.0."],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL."],
    "WTFPL": ["You just do what the fuck you want to public license."],
    "proprietary": [
        "Copyright by the company. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is confidential and proprietary information; unauthorized copying of this file, via any medium, is strictly prohibited without written permission.",
    ],
}
# Identifiers of the families' licences in the SPDX list.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL": "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later", "LGPL": "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later",
    "AGPL": "AGPL-3.0-only AGPL-3.0-or-later", "BSD": "BSD-2-Clause BSD-3-Clause", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "CC-BY": "CC-BY-4.0 CC-BY-3.0", "CC-BY-SA": "CC-BY-SA-4.0 CC-BY-SA-3.0",
    "CC-BY-NC": "CC-BY-NC-4.0", "CC0": "CC0-1.0", "Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "EPL-2.0": "EPL-2.0", "Artistic-2.0": "Artistic-2.0", "EUPL-1.2": "EUPL-1.2", "WTFPL": "WTFPL",
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {_id}" for _id in _ids.split()]

# Sentences with anchor words that are no licence notice.
HARMLESS = [
    "He lost his driving license on the way to the public library.",
    "The copyright debate went on in the commons until the evening.",
    "She asked for permission to speak at the public hearing.",
    "A new licence for the radio station was granted by the ministry.",
    "The apache helicopter landed in the public square.",
    "The domain of the function is the set of all rights angles.",
    "The warranty of the car ended in the second year.",
    "Creative people share the common rooms of the mozilla office.",
    "The gnu is a large animal that lives in the public park.",
    "Students of the institute need a fishing license and written permission.",
    "The wealth was to be redistributed among all public schools.",
    "Public transport is free of charge for any person with a permit.",
    "The museum granted free admission to the public without any conditions.",
    "All drivers must show a valid license and proof of insurance on request.",
    "The court held that the copyright in the novel had expired decades ago.",
    "He signed the licence agreement for the new television series in March.",
    "The software company moved its offices to the old harbour last year.",
    "Voting rights were extended to all citizens over eighteen.",
    "The committee redistributes the funds among its members every spring.",
    "Her permission was required before the letters could be published.",
    "The artist sold a copy of the painting to a private collector.",
    "The universal declaration of human rights was read out to the public.",
    "There is no warranty on used cars sold at the market.",
    "The foundation publishes its general report in the summer.",
    "An identifier is printed on the back of every license plate.",
    "The general public was not admitted to the version shown in Berlin.",
]
_FILLER = "the of and to in is that it for was on are as with his they at be this have from or one had by word but not what all were we when your can said".split()
# Function words; an n-gram of these alone is no feature.
FUNCTION_WORDS = frozenset([*_FILLER, *"a an any do if its may no so such their there these which will you".split()])
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def ngrams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def shingles(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


def pieces(tokens: list[str]) -> set[str]:
    """All that a paragraph is compared by: its n-grams of one to four words and its shingles."""
    return ngrams(tokens) | {" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)} | shingles(tokens)


def labelled_paragraphs(count: int = 4800, seed: int = 3) -> list[tuple[str, str]]:
    """``(paragraph, family)``: templates and harmless sentences with lost words, cut ends and text around them, and such text alone.

    Made-up words are too long to repeat, so none becomes a feature.
    """
    rng = random.Random(seed)
    families = list(TEMPLATES)
    found = []
    for k in range(count):
        family = UNKNOWN if k % 3 == 0 else families[k // 3 % len(families)]
        tokens = words(rng.choice(HARMLESS if family == UNKNOWN else TEMPLATES[family]))
        if family == UNKNOWN and rng.random() < 0.3:
            tokens = words(rng.choice(TEMPLATES[rng.choice(families)]))
            rng.shuffle(tokens)
        if len(tokens) > 8 and rng.random() < 0.4:
            tokens = [t for t in tokens if rng.random() > 0.1]
        if family == UNKNOWN and rng.random() < 0.3:
            tokens = []
        pad = [[rng.choice(_FILLER) if rng.random() < 0.6 else "".join(rng.choice("abdeghinorstuv") for _ in range(rng.randint(5, 9))) for _ in range(rng.choice((0, 0, 3, 12, 30)))] for _ in range(2)]
        found.append((" ".join([*pad[0], *tokens, *pad[1]]), family))
    return found


@dataclass
class LicenceModel:
    """Classes (the first is unknown), weights by n-gram, biases and the temperature."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float

    def probabilities(self, paragraph: str) -> dict[str, float]:
        """What the DataFrame plan computes, for one paragraph."""
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in ngrams(words(paragraph)) if g in self.weights), np.zeros(len(self.classes)))
        e = np.exp((z - z.max()) / self.temperature)
        return dict(zip(self.classes, (e / e.sum()).tolist()))


def train(paragraphs: list[tuple[str, str]] | None = None, steps: int = 200, l2: float = 3e-4, least: int = 3) -> LicenceModel:
    """Fit on labelled paragraphs; every fifth is kept for the temperature.  Features are n-grams with a word that is no function word."""
    paragraphs = labelled_paragraphs() if paragraphs is None else paragraphs
    classes = [UNKNOWN, *sorted({c for _, c in paragraphs} - {UNKNOWN})]
    sets = [ngrams(words(p)) for p, _ in paragraphs]
    y = np.array([classes.index(c) for _, c in paragraphs])
    own = np.arange(len(y)) % 5 != 0
    seen = Counter(g for k in np.flatnonzero(own) for g in sets[k])
    index = {g: k for k, g in enumerate(sorted(g for g, n in seen.items() if n >= least and not FUNCTION_WORDS.issuperset(g.split())))}
    x = np.zeros((len(y), len(index) + 1), np.float32)
    x[:, -1] = 1
    for k, grams in enumerate(sets):
        x[k, [index[g] for g in grams if g in index]] = 1
    w = np.zeros((x.shape[1], len(classes)), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    a, target = x[own], np.eye(len(classes), dtype=np.float32)[y[own]]
    for step in range(1, steps + 1):
        z = a @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = a.T @ (p - target) / len(a) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = np.where(np.abs(w) < 0.02, 0, np.round(w.astype(float), 4))
    z, t = x[~own] @ w, y[~own]

    def loss(temperature: float) -> float:
        q = z / temperature
        return float((np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1)) + q.max(axis=1) - q[np.arange(len(t)), t]).mean())

    temperature = min((0.5, 0.7, 1.0, 1.3, 1.7, 2.2, 3.0), key=loss) if len(t) else 1.0
    weights = {g: w[k].tolist() for g, k in index.items() if w[k].any()}
    return LicenceModel(classes, weights, w[-1].tolist(), temperature)


def telling(model: LicenceModel) -> list[str] | None:
    """Words of which every paragraph with a family holds one; none if the biases alone may give one.

    A family of probability 0.5 or more is likelier than unknown.  With biases that favour unknown, that takes an n-gram
    whose weight for the family is above that for unknown, and so each of its words.
    """
    if max(model.bias[1:], default=-np.inf) >= model.bias[0]:
        return None
    grams = [set(g.split()) for g, w in model.weights.items() if max(w[1:]) > w[0]]
    return sorted(set().union(*[g - FUNCTION_WORDS or g for g in grams]))


def _templates(classes: list[str]) -> list[tuple[int, set[str]]]:
    return [(classes.index(f), shingles(words(t))) for f, texts in TEMPLATES.items() if f in classes for t in texts]


def _model_table(df: DataFrame, model: LicenceModel) -> DataFrame:
    """``(gram, w, templates)`` as a literal of the plan: weights of n-grams, and the templates that hold a shingle."""
    rows = {g: {"gram": g, "w": w} for g, w in model.weights.items()}
    for number, (_, grams) in enumerate(_templates(model.classes)):
        for g in grams:
            rows.setdefault(g, {"gram": g}).setdefault("templates", []).append(number)
    literal = json.dumps(list(rows.values()))
    one = df.sparkSession.range(1)
    return one.select(F.inline(F.from_json(F.lit(literal), "array<struct<gram:string,w:array<double>,templates:array<int>>>")))


def paragraphs_of(text: Column) -> Column:
    """Lower-cased paragraphs: lines, with a line that doesn't end a sentence joined to the next."""
    joined = F.regexp_replace(F.lower(text), r"(?<![.!?:;\s])[ \t]*\r?\n(?=[^\r\n])", " ")
    return F.split(joined, r"[\r\n]+")


def _grams(tokens: Column) -> Column:
    """Distinct n-grams of one to four words and shingles of ``SHINGLE`` words (or all words, if fewer)."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3), runs(4), runs(SHINGLE)))


def classify(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, family, probability, p_unknown, similarity, confirmed)`` of each paragraph with a family or an anchor word."""

    def anchored(text: Column) -> Column:
        return reduce(lambda found, a: found | text.contains(a), ANCHORS, F.lit(False))

    words_of = F.regexp_extract_all("p", F.lit(_WORD), 0)
    marks = telling(model)
    undecided = F.size(words_of) > 0 if marks is None else F.arrays_overlap(words_of, F.array(*[F.lit(w) for w in marks]).cast("array<string>"))
    candidates = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", F.posexplode(paragraphs_of(F.col("text"))).alias("paragraph", "p"))
        .where(anchored(F.col("p")) | undecided)
        .select("doc_id", "row", "paragraph", anchored(F.col("p")).alias("anchored"), words_of.alias("tokens"))
        .select("doc_id", "row", "paragraph", "anchored", F.explode(_grams(F.col("tokens"))).alias("gram"))
    )
    # the left join keeps candidates without any known n-gram: their class is unknown
    met = candidates.join(F.broadcast(_model_table(docs, model)), "gram", "left")
    k = len(model.classes)
    sums = met.groupBy("row", "doc_id", "paragraph", "anchored").agg(
        F.array(*[F.coalesce(F.sum(F.get("w", F.lit(c))), F.lit(0.0)) + F.lit(model.bias[c]) for c in range(k)]).alias("z"),
        F.flatten(F.collect_list("templates")).alias("hits"),
    )
    parts = _templates(model.classes)
    likeness = F.array(*[F.lit(1.0 / len(grams)) for _, grams in parts])
    of_class = F.array(*[F.lit(c) for c, _ in parts])
    similar = F.transform(
        F.sequence(F.lit(0), F.lit(len(parts) - 1)),
        lambda t: F.struct(F.get(of_class, t).alias("c"), (F.size(F.filter("hits", lambda h: h == t)) * F.get(likeness, t)).alias("s")),
    )
    heat = F.transform("z", lambda x: F.exp((x - F.array_max("z")) / F.lit(model.temperature)))
    # a family has to be likelier than unknown; few paragraphs are left for the rest
    return (
        sums.where(F.col("anchored") | (F.array_max("z") > F.get("z", F.lit(0))))
        .withColumn("e", heat)
        .withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
        .withColumn("best", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
        .withColumn("best", F.when(F.array_max("p") >= 0.5, F.col("best")).otherwise(0))
        .where(F.col("anchored") | (F.col("best") > 0))
        .withColumn("similar", F.coalesce(F.array_max(F.transform(F.filter(similar, lambda x: x["c"] == F.col("best")), lambda x: x["s"])), F.lit(0.0)))
        .select(
            "doc_id",
            "paragraph",
            F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("best")).alias("family"),
            F.get("p", F.col("best")).alias("probability"),
            F.get("p", F.lit(0)).alias("p_unknown"),
            F.round("similar", 6).alias("similarity"),
            ((F.col("best") > 0) & (F.col("similar") >= SIMILARITY - 1e-9)).cast("int").alias("confirmed"),
        )
    )
