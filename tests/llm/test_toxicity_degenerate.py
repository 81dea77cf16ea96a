from isoplane.llm import toxicity


def test_nothing_learned_keeps_all_rows(spark):
    docs = spark.createDataFrame([(i, f"clean text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(docs, toxicity.train(docs, labels)).count() == 40


def test_oversize_text_is_skipped(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 500 if i < 30 else f"short {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda a, b, undo: seen.append((a, b)))
    toxicity.train(docs, labels, max_chars=400)
    (toxic, other), = seen
    assert len(toxic) > 5 and len(other) > 5 and all(t.startswith("short") for t in toxic + other)
