import itertools

import numpy as np
import pytest

from isoplane.llm import toxicity as X


def brute_marginals(e, trans):
    n, total, toxic, pairs = len(e), 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(e[i] * s for i, s in enumerate(path)) + sum(trans[a][b] for a, b in zip(path, path[1:])))
        total += p
        toxic += p * np.array(path)
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    return toxic / total, pairs / total


def test_marginals_sum_over_all_paths():
    rng = np.random.default_rng(0)
    lengths, trans = np.array([3, 1, 6, 2]), rng.normal(size=(2, 2))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    e = rng.normal(size=lengths.sum()) * 2
    got, pairs = X.marginals(e, starts, lengths, trans)
    want = [brute_marginals(e[s : s + n], trans) for s, n in zip(starts, lengths)]
    assert np.allclose(got, np.concatenate([w[0] for w in want])) and np.allclose(pairs, sum(w[1] for w in want))


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("aeioustrnl"), 5)) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choice(vocab, 40).tolist()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.integers(40)] = rng.choice(["vileword", "Nastiness", "nastily", "grubbing"])
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t, _ in rows], "doc_id long, text string, lang string, toxic string, score int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 1, 1), (7, 0, None), (None, 0, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, X.train(docs, labels)


def test_held_out_accuracy_and_spans(spark, trained):
    rows, docs, model = trained
    fresh = corpus(300, seed=9)
    got = {r.doc_id: r for r in X.score(spark.createDataFrame(fresh, "doc_id long, text string, y int"), model).collect()}
    assert sum((got[i].score >= 0.5) == bool(y) for i, _, y in fresh) >= 0.98 * len(fresh)
    for i, text, y in fresh:
        tagged = {text[s.start : s.end].lower() for s in got[i].spans}
        assert not y or tagged & {"vileword", "nastiness", "nastily", "grubbing"}
    right, _ = X.Scorer(model)([t for _, t, _ in fresh])
    assert np.allclose(right, [got[i].score for i, _, _ in fresh])


def test_edges(spark, trained):
    _, docs, model = trained
    odd = [(1, None), (2, ""), (3, "... !!"), (4, "vileword " * 30_000), (4, "vileword"), (None, "clean words"), (5, "İVILEWORD vileword")]
    got = sorted((str(r.doc_id), round(r.score, 6), len(r.spans)) for r in X.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect())
    by = {k: s for k, s, _ in got}
    assert by["1"] == by["2"] == by["3"] < 0.5 and all(0 <= s <= 1 for _, s, _ in got)
    assert X.score(docs.limit(0), model).collect() == []
    kept = X.keep_clean(docs, model)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


def test_without_labels(spark, trained):
    _, docs, _ = trained
    none = X.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in X.score(docs, none).collect()} == {0.0} and X.keep_clean(docs, none).count() == docs.count()
    one = X.train(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int"))
    assert {r.score for r in X.score(docs, one).collect()} == {1.0}
