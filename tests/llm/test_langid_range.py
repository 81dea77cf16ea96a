"""Words whose probability leaves the range of doubles."""

import numpy as np
import pytest

from isoplane.llm import langid as L

NAMES = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "ba"]
UNKNOWN = ["漢" * 20, "🥳" * 15, "ក" * 40, "🥳" * 40]


@pytest.fixture(scope="module")
def small():
    pieces = L.Pieces(NAMES)
    uses = np.full((len(NAMES), 2), 0.1)
    uses[pieces.ids["a"], 0] = uses[pieces.ids["b"], 1] = 1e6
    return pieces, np.log(uses / uses.sum(axis=0))


@pytest.mark.parametrize("word", UNKNOWN)
def test_unknown_characters_between_ordinary_documents(small, word):
    pieces, logp = small
    got = L.Lattice(["ab", word], pieces).log_totals(logp)
    assert np.isfinite(got).all() and np.allclose(got[1], L.long_word(word, pieces, logp))
    texts = ["aaa a", "bbb b", word, f"aa {word} a", None, "aaa a", "bbb b"]
    labels, scores = L.Identifier(L.Model(pieces, ["x", "y"], logp))(texts)
    assert [labels[k] for k in (0, 1, 5, 6)] == ["x", "y", "x", "y"] and labels[4] == "und"
    assert np.isfinite(scores).all()


@pytest.mark.parametrize("word", UNKNOWN)
def test_such_words_are_learned(small, word):
    pieces, logp = small
    uses = L.expected_counts(["ab", word], np.array([0, 1]), np.array([1.0, 3.0]), pieces, logp)
    spelled = sum(uses[b, 1] for b in range(256))
    assert np.isfinite(uses).all() and np.isclose(spelled, 3 * len(word.encode()))
    ordinary = [(p, n) for p, n in L.long_uses("abab", pieces, logp[:, 0])]
    want = L.expected_counts(["abab"], np.array([0]), np.array([1.0]), pieces, logp)[:, 0]
    mine = np.zeros(len(NAMES))
    for p, n in ordinary:
        np.add.at(mine, p, n)
    assert np.allclose(mine, want)
