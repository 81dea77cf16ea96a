import random
import zlib

import pytest
import math
import hashlib
import re

from isoplane.llm import resample as R


def plain(docs, bench, percent=25):
    """The contract read literally: rows of (doc_id, n_features, weight, score, rank)."""

    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for f in features(text)[1]:
            s[bucket(f)] += 1
    for text in bench:
        for f in features(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(fs), weight, score, None, i is not None and len(words) >= 20])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in rows], key=repr)


def corpus(n=700):
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "gamma9", "été", "naïve", "straße", "日本語", "x", "7", "I'm", "a-b", " ", "İ", "one\ttwo"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(n)]
    docs += [(None, "word " * 30), (5000, None), (5001, ""), (-7, "Alpha beta " * 4000), (3, docs[3][1]), (3, docs[3][1])]
    docs += [(9000 + k % 3, "same words " * 15) for k in range(60)]  # repeated rows
    return docs, ["alpha beta gamma9 été", None, "", "BETA x 7 " * 9]


@pytest.mark.parametrize("group, run, block", [(None, R.RUN, R.BLOCK), (20, 50, 4), (1, 7, 1), (10**6, 30, 5)])
def test_matches_the_plain_draw(spark, group, run, block):
    docs, bench = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    gain = R.gains(R.bucket_counts(frame), R.bucket_counts(target))
    rows = R.scored(frame, gain).cache()
    got = R.ranked(rows, 25 * rows.where("eligible").count() // 100, group, run, block)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain(docs, bench)


def test_heavy_scores_are_split_between_ids(spark):
    rows = spark.range(1, 3001).selectExpr("id * 37 - 50000 AS doc_id", "50L AS n_features", "5L AS weight", "id % 2 AS score", "true AS eligible").cache()
    assert len(R.plan(R._counted(rows, 2000, 100), 2000, 100)) > 15
    got = {r.doc_id: r["rank"] for r in R.ranked(rows, 2000, 100, 64, 8).collect()}
    order = sorted(got, key=lambda i: (-(((i + 50000) // 37) % 2), i))
    assert [got[i] for i in order] == [k + 1 if k < 2000 else None for k in range(3000)]


def test_nothing_to_draw_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c", 5, 7), (2, None, 1, 1)], "doc_id long, text string, rank int, Score int")
    assert R.resample(none, none).collect() == []
    got = sorted(tuple(r) for r in R.resample(some, none.select("text")).collect())
    assert [(r[0], r[1], r[4]) for r in got] == [(1, 5, None), (2, 0, None)]
    assert R.resample(some, some).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_tree_opens_blocks_only_when_due_and_stops():
    rng = random.Random(1)
    runs = [sorted((rng.randrange(50), rng.randrange(9), 0, 0, 1) for _ in range(rng.randrange(1, 40))) for _ in range(13)]
    blocks = sorted((r[k : k + 3] for r in runs for k in range(0, len(r), 3)), key=lambda b: b[0])
    every = sorted(e for r in runs for e in r)
    assert list(R.merge(blocks, 10**9)) == every
    taken = []

    def watched():
        for b in blocks:
            taken.append(b)
            yield b

    merged = R.merge(watched(), 20)
    assert [next(merged) for _ in range(20)] == every[:20]
    assert all(b[0] <= every[20] for b in taken[:-1]) and len(taken) < len(blocks)
    assert sorted(merged) == every[20:]
