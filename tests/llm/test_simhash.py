import itertools

import numpy as np
import pytest
import xxhash

from isoplane.llm import simhash


def slow_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius):
    up = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = up[i], up[j]
            if a != b:
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A b C d\x0be É É x y", "a b c " * 5000])
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_bit_sliced_comparison_finds_exactly_the_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps, keys = [], []
    for k, size in enumerate([1, 2, 3, 64, 65, 130, 1]):
        for _ in range(size):
            x = int(base[rng.integers(12)])
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.append(x)
            keys.append(k)
    fps, keys = np.array(fps, np.uint64), np.array(keys)
    for radius in (0, 1, 2, 3):
        i, j = simhash.linked_pairs(keys, fps, radius)
        want = {(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if keys[a] == keys[b] and bin(int(fps[a] ^ fps[b])).count("1") <= radius}
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == want


def test_segments_grow_with_the_rows():
    assert simhash.plan_segments(10**5, 2) == 3
    assert simhash.plan_segments(10**10, 2) > 3


@pytest.mark.parametrize("block", [4096, 8])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    for t in list(texts):
        for _ in range(5):
            w = t.split()
            w[rng.integers(len(w))] = "other"
            texts.append(" ".join(w))
    texts += [texts[0]] * 20 + [None, "", "  ", "two words", "Two WORDS"]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[0], "x"), (None, "unlike any", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    group = slow_components(fps, 2)
    low = {}
    for (i, _, _), g in zip(rows, group):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    want = sorted((str(i), f, low.get(g)) for (i, _, _), f, g in zip(rows, fps, group))
    got = simhash.components(docs).collect()
    assert sorted(((str(r[0]), r[1] % 2**64, r[2]) for r in got), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(low.values())) and ids.count(None) == 2


def test_wide_fingerprints_and_large_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (5, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 5, 400)]
    for row in fps:
        for b in rng.integers(0, 256, rng.integers(0, 60)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    keys = np.sort(rng.integers(0, 6, 400))
    apart = np.unpackbits((fps[:, None] ^ fps[None]).view(np.uint8), axis=-1).sum(axis=-1, dtype=int)
    for radius in (1, 20, 72):
        i, j = simhash.linked_pairs(keys, fps, radius)
        want = {(a, b) for a, b in itertools.combinations(range(400), 2) if keys[a] == keys[b] and apart[a, b] <= radius}
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def test_blocks_are_cut_whole():
    import pandas as pd

    parts = [[1, 1], [1], [1, 2], [2, 2, 3], [], [4], [4, 5, 6, 6], [7]]
    got = [p["block"].tolist() for p in simhash.whole_blocks(pd.DataFrame({"block": np.array(p, np.int64)}) for p in parts)]
    assert sum(got, []) == sum(parts, [])
    assert sum(len(set(p)) for p in got) == 7


def test_unique_text_under_a_repeated_id_stays(spark):
    unique = "here is a text that no other row of the table has in it at all"
    copy = "some words that stand in this very order in two rows of the table"
    rows = [(1, copy, {"k": 1}), (5, copy, {"k": 2}), (5, unique, {"k": 3}), (5, unique, {"k": 3}), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>")
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, copy), (5, unique), (7, "")])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []
