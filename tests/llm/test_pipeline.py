"""The pipeline's stages against plain Python on small tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from isoplane.llm import mixing, secret_scan, simhash, toxicity  # noqa: E402

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(3, 7)))
    vocab = [word() for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    items = [(k, text(30)) for k in range(6)]
    docs, labels = [], []
    for i in range(400):
        t, toxic = text(rng.choice([10, 60, 200])), i % 8 == 0
        if toxic:
            t = t[:-1] + " vermin " + text(5) + " vermin scumbag " + text(4)
        if i % 20 == 3:
            t += f' token = "{KEY}" end'
        if i % 25 == 7:
            t += " " + items[i % 6][1]
        docs.append((i, t, rng.choice(["en", "de"]), f"src{i % 10}", len(t)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + k, docs[5][1], "en", "src1", 5) for k in range(30)] + [(2000, None, "en", "src1", None), (2001, "", None, None, 0), (5, docs[5][1], "en", "src1", 5), (None, text(9), "en", "src2", 3)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, items


def test_stages(spark, tables):
    sf, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, toxic), (_, dedup), (_, clean), (_, secrets), (_, mix) = corpus_pipeline.STAGES
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)

    first = toxic(spark, docs, sf).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores, _ = toxicity.Scorer(model)([r.text for r in docs.collect()])
    assert rows(first) == sorted((tuple(r) for r, s in zip(docs.collect(), scores) if s < 0.5), key=repr)
    assert first.count() < docs.count() - 40

    second = dedup(spark, first, sf).cache()
    fps = [(r, simhash.fingerprint(r.text)) for r in first.collect()]
    groups: list[set] = []
    for r, f in fps:
        near = [g for g in groups if any(bin(f ^ x).count("1") <= 2 for x in g)]
        groups = [g for g in groups if g not in near] + [set().union({f}, *near)]
    keep = {min((r.doc_id for r, f in fps if f in g and r.doc_id is not None), default=None) for g in groups} - {None}
    assert sorted(r.doc_id for r in second.collect() if r.doc_id is not None) == sorted(keep)
    assert second.columns == docs.columns and second.where("doc_id is null").count() == 1

    third = clean(spark, second, sf).cache()
    leaked = {r.doc_id for r in second.collect() if any(t.rstrip(".") in (r.text or "") for _, t in items)}
    assert leaked and {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - leaked

    fourth = secrets(spark, third, sf).cache()
    assert fourth.schema == third.schema and fourth.count() == third.count()
    for a, b in zip(rows(third), sorted(map(tuple, fourth.collect()), key=lambda x: repr(x).replace("[SECRET]", KEY))):
        assert b[1] == (a[1].replace(KEY, "[SECRET]") if a[1] else a[1])
    assert not any(KEY in (r.text or "") for r in fourth.collect())

    last = mix(spark, fourth, sf)
    assert rows(last) == rows(mixing.select(fourth)) and last.count() > 0
    assert rows(corpus_pipeline.run(spark, sf)) == rows(last)
    assert secret_scan.train() is not None


def test_empty_tables(spark, tables, tmp_path):
    sf, _ = tables
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
