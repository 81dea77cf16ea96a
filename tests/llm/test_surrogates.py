import re

from isoplane.llm import surrogates as S

KEY = b"test key"


def test_detects_kinds_and_leaves_clean_text():
    text = "Mail Jo.Ann@Mail2.example.com or +1 (830) 555-5433, ip 10.1.2.3, card 4111 1111 1111 1111, ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00. Mrs. Anna Smith met Herr Braun."
    kinds = [k for _, _, k, _ in S.detect(text)]
    assert kinds == ["email", "phone", "ip", "card", "ssn", "iban", "given-f", "surname", "surname"]
    for clean in (None, "", "Version 1.2.3.4.5 of 2024-01-02 costs 12,300.50 and 99.", "The The Of In. Anna went.", "x" * 10_000):
        assert S.detect(clean) == []


def test_formats_are_kept():
    for kind, text in [("phone", "+1 (830) 555-5433"), ("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("email", "Jo.Ann92@mail2.example.com"), ("ip", "192.168.3.4")]:
        (a, b, k, norm), = S.detect(text)
        new = S.render(text, kind, S.surrogate(k, norm, 0, KEY))
        shape = lambda t: re.sub(r"\d+" if kind == "ip" else r"\d", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", t)))
        assert (a, b, k) == (0, len(text), kind) and new != text and shape(new) == shape(text)
        (_, _, again, norm2), = S.detect(new)
        assert again == kind
    assert S._luhn(S.surrogate("card", "4111111111111111", 5, KEY)) and S._iban_ok(S.surrogate("iban", "DE89370400440532013000", 1, KEY))
    assert S.surrogate("ip", "192.168.3.4", 0, KEY).startswith("192.168.")
    assert S.script_of(S.surrogate("given-f", "елена", 0, KEY)) == "cyrillic"
    assert any(S.surrogate("given-m", "john", 0, KEY).endswith(e) for e in S.ENDINGS[("m", "latin")])


def test_replacement_is_coreferent_and_distinct(spark):
    rows = [(i, f"call +1 (830) 555-{i:04d} now" if i < 300 else f"call 1830555{i - 300:04d} x" if i < 0 else "clean text", i) for i in range(400)]
    rows += [(1000, "Write to ann@x.org or ANN@X.ORG; 10.0.0.1. Mr. John Smith and Anna Smith", 1), (1001, "ann@x.org again, Mrs Smith", 1), (1001, "ann@x.org again, Mrs Smith", 1), (None, None, 1), (None, "bob@x.org", 1), (1002, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entities int")
    got = S.replace(docs, KEY)
    assert got.columns == ["doc_id", "text", "entities", "n_entities"]
    out = {}
    for r in got.collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert sum(map(len, out.values())) == len(rows)
    assert all(out[i] == ["clean text"] for i in range(300, 400)) and out[1002] == [""]
    phones = {out[i][0] for i in range(300)}
    assert len(phones) == 300 and not phones & {t for _, t, _ in rows}
    first, second = out[1000][0], out[1001][0]
    mail = re.search(r"[\w.]+@[\w.]+", first)[0]
    assert mail.upper() in first and mail in second and "ann@x.org" not in second and out[1001][0] == out[1001][1]
    assert mail.split("@")[1] == re.search(r"@([\w.]+)", [t for t in out[None] if t][0])[1]
    names = re.search(r"Mr\. (\w+) (\w+) and (\w+) (\w+)", first)
    assert names[2] == names[4] and f"Mrs {names[2]}" in second and names[1] != names[3] and "Smith" not in first


def test_no_surrogate_is_shared_or_real(spark):
    entities = spark.createDataFrame([("ssn", f"{i:04d}") for i in range(1000)], "kind string, norm string")
    got = S.entity_map(entities, KEY).collect()
    assert len(got) == 1000 == len({r.surrogate for r in got})
    assert not {r.surrogate for r in got} & {r.norm for r in got}


def test_empty(spark):
    assert S.replace(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []


def test_a_given_name_is_one_entity(spark):
    docs = spark.createDataFrame([(1, "Dr. Xan Smith and Mr. Xan Smith"), (2, "Mrs. Kim Lee, Mr. Kim Lee"), (3, "Anna-Maria Schmidt und Łukasz; Herr Łukasz Żak")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in S.replace(docs, KEY).collect()}
    first = re.fullmatch(r"Dr\. (\w+) (\w+) and Mr\. (\w+) (\w+)", out[1])
    assert first[1] == first[3] != "Xan" and first[2] == first[4] != "Smith"
    assert any(first[1].lower().endswith(e) for e in S.ENDINGS[("m", "latin")])
    second = re.fullmatch(r"Mrs\. (\w+) (\w+), Mr\. (\w+) (\w+)", out[2])
    assert second[1] == second[3] and any(second[1].lower().endswith(e) for e in S.ENDINGS[("n", "latin")])
    assert re.fullmatch(r"[A-Z]\w+-[A-Z]\w+ [A-Z]\w+ und Łukasz; Herr [A-Z]\w+ [A-Z]\w+", out[3]) and "Żak" not in out[3] and "Maria" not in out[3]


def test_all_kinds_stay_distinct(spark):
    domains = [("domain", f"{chr(97 + k)}.org") for k in range(26)]
    names = [(kind, f"{a}{b}{c}") for kind in ("given-n", "surname") for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmn"]
    ips = [("ip", f"192.168.{a}.{b}") for a in range(8) for b in range(100)]
    got = S.entity_map(spark.createDataFrame([*domains, *names, *ips], "kind string, norm string"), KEY).collect()
    assert len(got) == len(domains) + len(names) + len(ips)
    for space in (["domain"], ["given", "surname"], ["ip"]):
        own = [r for r in got if r.kind in space]
        assert len({r.surrogate for r in own}) == len(own) and not {r.surrogate for r in own} & {r.norm for r in own}


def test_an_exhausted_format_raises(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(S, "REAL_ROUNDS", 1)
    monkeypatch.setattr(S, "MAX_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="ssn"):
        S.entity_map(spark.createDataFrame([("ssn", f"{i}") for i in range(10)] + [("ssn", f"0{i}") for i in range(10)], "kind string, norm string").where("length(norm) = 1").union(spark.range(5).selectExpr("'ssn'", "cast(id as string)")), KEY)
        S.entity_map(spark.createDataFrame([("ssn", f"{i}") for i in range(10)], "kind string, norm string"), KEY)


def test_many_entities_in_one_text():
    import time

    text = " ".join(f"u{k}@h{k % 50}.org" for k in range(100_000))
    start = time.time()
    spans = [dict(zip(("start", "end", "kind", "norm"), x)) for x in S.detect(text)]
    new = {("email", s["norm"]): "x" + s["norm"] for s in spans} | {("domain", f"h{k}.org"): f"g{k}.net" for k in range(50)}
    out = S.replaced(text, spans, new)
    assert len(spans) == 100_000 and out.startswith("xu0@g0.net xu1@g1.net") and time.time() - start < 20


def test_the_query_against_plain_python(spark):
    """All of ``replace``: spans by ``detect``, one surrogate for each entity, everything else unchanged."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(10**6 + k, rows[k % 7].text) for k in range(40)] + [(None, "call 1700000000000 or 4111111111111111")]
    got = sorted(S.replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect(), key=lambda r: str(r.doc_id))
    rows.sort(key=lambda r: str(r[0]))
    seen: dict[tuple, str] = {}
    count = 0
    for (i, text), r in zip(rows, got, strict=True):
        spans = S.detect(text)
        assert r.doc_id == i and r.n_entities == len(spans)
        at, new = 0, r.text
        for k, (a, b, kind, norm) in enumerate(spans):
            assert new.startswith(text[at:a])
            new = new[a - at :]
            end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
            after = text[b:end]
            stop = new.index(after, 1) if after else len(new)
            own = new[:stop].lower() if kind in ("email",) or "given" in kind or kind == "surname" else re.sub(r"[^0-9A-Za-z.]", "", new[:stop])
            if kind not in ("phone", "ssn", "card", "ip"):
                assert seen.setdefault((S.who(kind), norm), own) == own
            assert new[:stop] != text[a:b]
            new, at, count = new[stop:], b, count + 1
        assert new == text[at:] if text else new == text
    assert count > 20 and len(set(seen.values())) == len(seen)
