import random
import re

import pytest

from isoplane.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[%$€£°]", (text or "").lower())


def brute(docs, items):
    found = set()
    for d, text in docs:
        w = words(text)
        have = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        if len(w) >= 5:
            have |= {tuple(w[i : i + n]) for n in (3, 4) for i in range(len(w) - n + 1)}
        for k, item in items:
            v = words(item)
            if v:
                own = [tuple(v[i : i + 5]) for i in range(max(1, len(v) - 4))]
                if sum(x in have for x in own) >= 0.8 * len(own):
                    found.add((d, k))
    return found


def test_literal_leaks_match_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "qwxyz" for b in "aeiou"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 20, 40])))) for i in range(25)]
    docs = []
    for d in range(120):
        body = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 30, 200]))]
        if d % 3 == 0:
            part = items[rng.randrange(25)][1].split()
            if d % 2:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "... ---"), (903, items[0][1]), (903, items[0][1])]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)


ITEM = "Alice buys 12 apples and 5 pears at the market, then gives 12 apples to Bob who already had 5 kg of plums at home."


@pytest.mark.parametrize(
    "text, leak, template",
    [
        (ITEM, True, False),
        ("Before it. " + ITEM.upper() + " After it.", True, False),
        (ITEM.replace("12", "31").replace("5", "8").replace("Alice", "Carol"), True, True),
        (ITEM.replace("12 apples and", "31 apples and").replace("5 pears", "8 pears"), False, None),  # the same number became two
        ("Somebody sells a lot of fruit at the market and goes home.", False, None),
    ],
)
def test_slots_must_be_consistent(spark, text, leak, template):
    docs = spark.createDataFrame([(1, text, "a", "b")], "doc_id long, text string, item_id string, h string")
    items = spark.createDataFrame([(7, ITEM, "x")], "item_id long, text string, doc_id string")
    got = D.leaks(docs, items).collect()
    assert [(r.item_id, r.template) for r in got] == ([(7, template)] if leak else [])
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == (0 if leak else 1)


def test_empty_and_shuffled(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string")
    assert D.leaks(none, items).collect() == []
    docs = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, "clean text of some more words")], "doc_id long, text string")
    assert D.leaks(docs, items.limit(0)).collect() == []
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert {r.doc_id for r in D.leaks(docs, items).collect()} == {1, None}
    assert {r.doc_id for r in D.keep_clean(docs, items).collect()} == {2}


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((r.doc_id or -1, r.item_id) for r in D.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())


def test_rows_are_judged_each(spark):
    words = ITEM.split()
    half = [" ".join(words[:12]), " ".join(words[8:])]
    assert found(spark, [(1, half[0]), (1, half[1]), (None, half[0]), (None, half[1])], [(7, ITEM)]) == []
    docs = spark.createDataFrame([(1, ITEM, 1), (1, "a clean text", 2), (None, ITEM, 3), (None, "clean too", 4)], "doc_id long, text string, row long")
    kept = D.keep_clean(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string"))
    assert sorted(r["row"] for r in kept.collect()) == [2, 4] and kept.columns == docs.columns


def test_short_items_inside_texts(spark):
    items = [(1, "What is two plus?"), (2, "Who is he"), (3, "or not")]
    docs = [(1, "Somebody asked: what is two plus, and nobody knew."), (2, "I wonder who is he now and why, or not at all"), (3, "Who is he?"), (4, "Or not"), (5, "who was he then, as he is not here")]
    assert found(spark, docs, items) == [(1, 1), (2, 2), (3, 2), (4, 3)]


def test_questions_dense_with_slots(spark):
    item = "Alice buys 3 kg, Bob 4 kg, Carol 5 kg and Dave 12 kg of flour. How many kg of flour do they buy together?"
    other = "Emma buys 7 kg, Mark 9 kg, Laura 2 kg and Peter 31 kg of flour. How many kg of flour do they buy together?"
    assert found(spark, [(1, "Here: " + other), (2, item), (3, "Emma buys flour. How many do they buy?")], [(9, item)]) == [(1, 9), (2, 9)]
    numbers = "1 2 3 4 5 6 7 8 9"
    assert found(spark, [(1, "so: " + numbers), (2, "so: 11 12 13 14 15 16 17 18 19")], [(9, numbers)]) == [(1, 9)]


def test_a_variant_does_not_hide_the_original(spark):
    variant = ITEM.replace("12 apples and", "31 apples and").replace("5 pears", "8 pears")
    assert found(spark, [(1, variant + " " + ITEM), (2, variant + " and " + variant)], [(9, ITEM)]) == [(1, 9)]


def test_german_nouns_are_no_names(spark):
    item = "Der Lehrer gibt dem Schüler ein Buch und der Schüler gibt dem Lehrer ein Heft."
    assert found(spark, [(1, "Der Bäcker gibt dem Kunden ein Brot und der Kunde gibt dem Bäcker ein Geld."), (2, item)], [(9, item)]) == [(2, 9)]


def test_long_text_and_other_digits(spark):
    long = " ".join(f"w{k % 700}" for k in range(120_000))
    item = "Rahim has ٣ baskets with ١٢ mangoes in each of them and sells half of the mangoes."
    docs = [(1, long + " " + ITEM + " " + long), (2, item.replace("٣", "٥").replace("١٢", "٢٠"))]
    assert found(spark, docs, [(9, ITEM), (8, item)]) == [(1, 9), (2, 8)]


def test_sql_states_the_same_leaks(spark):
    import duckdb

    rng = random.Random(8)
    names = ["Alice", "Bob", "Anna", "Zoe", "Li", "Ed"]
    item = lambda: " ".join(rng.choice([*names, "12", "5", "kg", "apples", "went", "then", "to", "the", "market", "and", "had", "3.5", "%"]) for _ in range(rng.choice([3, 6, 12, 25])))
    items = [(i, item()) for i in range(30)] + [(3, item()), (31, None)]
    swap = {"Alice": "Zoe", "12": "31", "Bob": "Ed", "5": "8"}
    docs = []
    for d in range(150):
        t = items[rng.randrange(30)][1].split()
        if d % 3 == 1:
            t = [swap.get(x, x) for x in t]
        if d % 3 == 2:
            t = [rng.choice(["7", "9"]) if x.isdigit() else x for x in t]
        docs.append((d, " ".join([item(), *t, item()]) if d % 4 else " ".join(t)))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = con.execute(D.oracle()).fetchall()
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert any(r.template for r in got) and any(not r.template for r in got)
    assert sorted(map(tuple, got)) == sorted(want)
