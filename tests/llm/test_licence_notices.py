"""Notices on their own: none is dropped before the classifier, and templates are confirmed."""

import random

from isoplane.llm import licences as L


def test_each_template_alone_is_confirmed(spark):
    rows = [(k, t, f) for k, (t, f) in enumerate((t, f) for f, texts in L.TEMPLATES.items() for t in texts)]
    rows += [(900, "Released under the ISC License.", "ISC"), (901, "Licensed under CC BY 4.0.", "CC-BY"), (902, "Released under CC BY 4.0", "CC-BY")]
    got = {r.doc_id: (r.family, r.confirmed) for r in L.classify(spark.createDataFrame(rows, "doc_id long, text string, f string"), L.train()).collect()}
    assert [(t, got.get(k)) for k, t, f in rows if got.get(k) != (f, 1)] == []


def test_short_notices_reach_the_classifier(spark):
    texts = ["GPL-2.0-or-later", "CC0 1.0 Universal", "BSD-3-Clause", "without warranties of any kind", "AGPL-3.0-only", "CC-BY-4.0", "MPL-2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in L.classify(docs, L.train()).collect()} == set(range(len(texts)))


def test_notices_without_an_anchor_word(spark):
    """The Unlicense's own second paragraph, names of licences, and a notice with a misspelt word."""
    rows = [
        ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense", 1),
        ("This software is provided 'as-is', without any express or implied waranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Zlib", 1),
        ("Distributed under the terms of the EPL-2.0", "EPL-2.0", 0),
    ]
    assert not any(a in t.lower() for t, _, _ in rows for a in L.ANCHORS)
    docs = spark.createDataFrame([(k, "First words.\n" + t) for k, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in L.classify(docs, L.train()).collect()}
    assert got == {(k, 1): (f, c) for k, (_, f, c) in enumerate(rows)}


def test_every_paragraph_is_classified(spark):
    """The plan leaves out what the model alone calls unknown, and nothing else; prose without a notice is unknown."""
    rng = random.Random(11)
    source = [L.words(t) for t, _ in L.labelled_paragraphs(600, seed=12)]
    source += [t[: rng.randint(1, len(t))] for t in map(L.words, sum(L.TEMPLATES.values(), [])) for _ in range(3)]
    texts = [" ".join(w for w in t if not any(a in w for a in L.ANCHORS)) for t in source]
    prose = ["der und mit chber in keit ver die en er au mit sich", "la que de les un et ci es mit", "the th er of on and ha it nd was by mit"]
    texts += prose
    for model in (L.train(), L.LicenceModel(["unknown", "MIT"], {"mit": [0.0, 3.0], "by the": [0.0, 2.0]}, [1.0, 0.0], 1.0), L.LicenceModel(["unknown", "MIT"], {"mit": [1.0, 0.0]}, [0.0, 1.0], 1.0)):
        wanted = {}
        for k, t in enumerate(texts):
            p = model.probabilities(t)
            best = max(p, key=p.get)
            if L.words(t) and (any(a in t for a in L.ANCHORS) or best != L.UNKNOWN and p[best] >= 0.5):
                wanted[k] = best if p[best] >= 0.5 else L.UNKNOWN
        got = {r.doc_id: r.family for r in L.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
        assert got == wanted and len(wanted) > 20
        if len(model.classes) > 2:
            assert not set(range(len(texts) - len(prose), len(texts))) & set(got)
