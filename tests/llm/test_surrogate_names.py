"""Names after capitalised words, and with several given names."""

import pytest

from isoplane.llm import surrogates as S


@pytest.mark.parametrize(
    "text, names",
    [
        ("Dear John Smith, hello", ["John", "Smith"]),
        ("Yesterday Anna Schmidt came", ["Anna", "Schmidt"]),
        ("Die Kollegin Anna Schmidt kam", ["Anna", "Schmidt"]),
        ("Our President John Smith spoke", ["John", "Smith"]),
        ("Anna Maria Schmidt kam", ["Anna", "Maria", "Schmidt"]),
        ("Dr. Hans Peter Mueller kam", ["Hans", "Peter", "Mueller"]),
        ("Dr. Zoltan Maria Mueller kam", ["Zoltan", "Maria", "Mueller"]),
        ("Mr. John came", ["John"]),
        ("Anna Smith Herr Braun", ["Anna", "Smith", "Braun"]),
        ("Вчера Анна Петрова пришла", ["Анна", "Петрова"]),
    ],
)
def test_whole_names(text, names):
    found = S.detect(text)
    assert [text[a:b] for a, b, _, _ in found] == names
    assert found[-1][2] == "surname" and all(k.startswith("given-") for _, _, k, _ in found[:-1]) or "Braun" in names
    assert [k for _, _, k, _ in S.detect("Anna Smith Herr Braun")] == ["given-f", "surname", "surname"]


def test_no_name():
    for clean in ("Dear Reader", "The Old House. Anna went.", "Kollegin Anna kam", ""):
        assert S.detect(clean) == []
