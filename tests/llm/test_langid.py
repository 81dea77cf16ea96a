import itertools
import math

import numpy as np
import pytest

from isoplane.llm import langid as L

NAMES = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "aba", "▁ab", "ba", "é"]


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(0)
    pieces = L.Pieces(NAMES)
    p = rng.random((len(NAMES), 2)) + 0.1
    return pieces, np.log(p / p.sum(axis=0))


def brute(word, pieces, logp):
    w, total = "▁" + word, np.zeros(logp.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(w) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
        p = np.ones(logp.shape[1])
        for a, b in zip(at, at[1:]):
            part = w[a:b]
            if part in pieces.ids:
                p = p * np.exp(logp[pieces.ids[part]])
            elif b - a == 1:
                p = p * np.exp(logp[[pieces.bytes[x] for x in part.encode()]].sum(axis=0))
            else:
                p = p * 0
        total += p
    return np.log(total)


def test_forward_sums_all_segmentations(small):
    pieces, logp = small
    words = ["a", "ab", "abab", "ababab", "zé", "aéba", "ß", "bbbbbbbb"]
    got = L.Lattice(words, pieces).log_totals(logp)
    for k, w in enumerate(words):
        assert np.allclose(got[k], brute(w, pieces, logp))
        assert np.allclose(L.long_word(w, pieces, logp), got[k])


def test_long_words_do_not_underflow(small):
    assert np.isfinite(L.long_word("ab" * 4000, *small)).all()


def test_expected_counts_spend_each_word_once(small):
    pieces, logp = small
    uses = L.expected_counts(["abab", "a"], np.array([0, 1]), np.array([2.0, 1.0]), pieces, logp)
    letters = np.array([1 if n.startswith("<0x") else len(n) for n in NAMES])
    assert np.allclose(letters @ uses, [2 * 5, 2])


def test_trained_on_documents(spark):
    texts = {"xx": "the thing that then", "yy": "der die dass dort"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(texts[lang].split() * 4)), lang) for i in range(60) for lang in texts if i % 2 == (lang == "yy")]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "12 34 !!", "yy"), (903, "thing " * 3 + "q" * 500, None), (None, "der die", None), (905, "der die", None), (905, "der die", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, L.train(docs)).collect()}
    assert all(got[i][0] == ("yy" if i % 2 else "xx") for i in range(60))
    assert [got[i][0] for i in (900, 901, 902, 903, None, 905)] == ["und", "und", "und", "xx", "yy", "yy"]
    assert got[900][1] == 0 and all(0 <= s <= 1 and not math.isnan(s) for _, s in got.values())
    assert L.predict(docs, L.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert L.predict(docs.limit(0), L.train(docs)).count() == 0
