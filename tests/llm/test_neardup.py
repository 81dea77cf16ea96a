"""The near-dedup stage against all pairs: Jaccard similarity of five-word shingles."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from isoplane.llm import neardup, simhash  # noqa: E402


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_by_jaccard(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    docs = []
    for k in range(60):
        body = [rng.choice(vocab) for _ in range(rng.choice([40, 120, 300]))]
        docs.append((10 * k, " ".join(body)))
        for c in range(1, 5):
            near = list(body)
            for _ in range(rng.choice([1, 2, 3, 5])):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            docs.append((10 * k + c, " ".join(near[: len(near) - rng.randrange(4)])))
    docs += [(900, docs[0][1].upper()), (901, None), (902, ""), (903, "two words"), (904, "Two  words"), (905, "two word"), (None, docs[0][1]), (0, docs[0][1])]
    sets = [(i, shingles(t)) for i, t in docs]
    linked = [(a, b) for k, a in enumerate(sets) for b in sets[:k] if jaccard(a[1], b[1]) >= 0.8]
    far = sum(bin(simhash.fingerprint(dict(docs)[a[0]]) ^ simhash.fingerprint(dict(docs)[b[0]])).count("1") > 2 for a, b in linked if a[0] and b[0])
    assert far > 50
    low = {i: i for i, _ in docs if i is not None}
    for _ in docs:
        for (a, _), (b, _) in linked:
            if a is not None and b is not None:
                low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({m for m in low.values()})
    assert sum(r.doc_id is None for r in kept) == 1


def test_one_large_group(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for k in range(800):
        near = list(base)
        near[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(near)))
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]


def test_unique_text_under_a_repeated_id_stays(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    copy, unique = text(), text()
    rows = [(1, copy, "a"), (5, copy + " end", "b"), (5, unique, "c"), (5, unique, "d"), (None, copy, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, copy, "a"), (5, unique, "c"), (None, copy, "e")], key=str)


@pytest.mark.parametrize("block, shingles", [(4096, 1_000_000), (16, 2000)])
def test_pairs_below_the_similarity_in_one_group(spark, monkeypatch, block, shingles):
    """Many texts that share much but not enough, and links between a few of them, in blocks of any size."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", shingles)
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = []
    for k in range(120):
        near = list(base)
        for _ in range(rng.choice([1, 3, 6, 9, 12])):
            near[rng.randrange(150)] = f"x{rng.randrange(9000)}"
        docs.append((k, " ".join(near)))
    docs += [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 7, 20])))) for k in range(200, 230)]
    sets = [shingles_of for _, t in docs for shingles_of in [globals()["shingles"](t)]]
    low = {i: i for i, _ in docs}
    for _ in range(20):
        for a in range(len(docs)):
            for b in range(a):
                if low[docs[a][0]] != low[docs[b][0]] and jaccard(sets[a], sets[b]) >= 0.8:
                    low[docs[a][0]] = low[docs[b][0]] = min(low[docs[a][0]], low[docs[b][0]])
    want = sorted(i for i in low if low[i] == i)
    assert 20 < len(want) < 140
    kept = neardup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == want
