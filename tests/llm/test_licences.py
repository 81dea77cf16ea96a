import pytest

from isoplane.llm import licences as L


@pytest.fixture(scope="module")
def model():
    return L.train()


def test_held_out_paragraphs(model):
    found = L.labelled_paragraphs(900, seed=77)
    right = sum(max((p := model.probabilities(t)), key=p.get) == c for t, c in found)
    assert right >= 0.95 * len(found)


def test_classes_of_documents(spark, model):
    filler = "thion nter oned ing and the of " * 40
    rows = [
        (1, "First line here.\nLicensed under the Apache License, Version 2.0.\nlast line"),
        (2, "Released under the MIT License."), (2, "Released under the MIT License."),
        (3, filler + ".\nThis work is licensed under the GNU General Public\nLicense, version 3.\n" + filler),
        (4, "Licensed under CC BY-NC 4.0."), (5, "He has lost his driving license."), (6, None), (7, ""), (8, filler), (None, "Licensed under CC BY-SA 4.0."), (9, "COPYRIGHT"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, family string, p double")
    got = sorted((r.doc_id or 0, r.paragraph, r.family, r.confirmed) for r in L.classify(docs, model).collect())
    assert got == [
        (0, 0, "CC-BY-SA", 1), (1, 1, "Apache-2.0", 1), (2, 0, "MIT", 1), (2, 0, "MIT", 1), (3, 1, "GPL", 1), (4, 0, "CC-BY-NC", 1),
        (5, 0, "unknown", 0), (9, 0, "unknown", 0),
    ]
    assert L.classify(docs.limit(0), model).collect() == []


def test_plan_computes_the_model(spark, model):
    texts = [t for t, _ in L.labelled_paragraphs(150, seed=5) if any(a in t for a in L.ANCHORS)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.classify(docs, model).collect()}
    assert set(got) == set(range(len(texts)))
    for k, t in enumerate(texts):
        p = model.probabilities(t)
        best = max(p, key=p.get) if max(p.values()) >= 0.5 else "unknown"
        assert got[k].family == best and abs(got[k].probability - p[best]) < 1e-9
        own = L.pieces(L.words(t))
        likeness = max((len(s & own) / len(s) for x in L.TEMPLATES.get(best, []) if (s := L.shingles(L.words(x)))), default=0)
        assert abs(got[k].similarity - likeness) < 1e-5


def test_main_path_has_no_python(spark, model):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = L.classify(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_notices_that_are_no_template(spark, model):
    """Notices in words that training has not seen, and sentences that are none."""
    notices = [
        ("// SPDX-License-Identifier: MIT", "MIT", 1), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0", 1), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL", 1),
        ("The MIT License (MIT) Copyright (c) 2019 Somebody Else", "MIT", 1), ("Released under the ISC License today, by all of us.", "ISC", 1),
        ("This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL", 1),
        ("All our code is licensed under the Apache License, Version 2.0, see below for the details.", "Apache-2.0", 1),
        ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "BSL-1.0", 1),
    ]
    others = ["The council renewed the fishing license of the village.", "Copyright law was the subject of the lecture.", "The public library opens at nine, with permission of the mayor.", "A license to kill is what the agent had in the film."]
    rows = [(k, t) for k, (t, _, _) in enumerate(notices)] + [(100 + k, t) for k, t in enumerate(others)]
    rows += [(200, "word " * 200_000 + "\n" + notices[0][0] + "\n" + "licence " * 50_000)]
    got: dict = {}
    for r in L.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, []).append((r.family, r.confirmed))
    assert [(t, got.get(k)) for k, (t, f, c) in enumerate(notices) if got.get(k) != [(f, c)]] == []
    assert all(not c for k, found in got.items() if 100 <= k < 200 for _, c in found)
    assert ("MIT", 1) in got[200] and sum(c for _, c in got[200]) == 1
