import random
import sys
import os

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import duck_rows, rows_of  # noqa: E402

from isoplane.llm import mixing as M


def documents():
    rng = random.Random(5)
    rows = [
        (i, " ".join(["w"] * rng.choice([1, 5, 40, 300])), rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0"] * 6 + [f"src{k}" for k in range(12)] + [None, "odd"]))
        for i in range(500)
    ]
    rows += [(1, "again", "en", "src0"), (1, "again", "en", "src0"), (None, "no id", "xx", "src3"), (600, None, "en", "src0"), (601, " \n", "en", "src0")]
    return rows


@pytest.mark.parametrize("plan", [M.MixPlan(), M.MixPlan(share=2.6, seed=1), M.MixPlan(share=9.0), M.MixPlan(share=0.05, sources={"src0": 1, "src7": 0}, default_weight=3)])
@pytest.mark.parametrize("bucket", [4096, 3])
def test_mixture_matches_the_plain_running_sums(spark, monkeypatch, plan, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    rows = documents()
    got = M.select(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), plan)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    sql = M.oracle(plan)
    if 0 in plan.sources.values():
        sql = sql.replace("FROM leaf0),\ndom", "FROM leaf0 WHERE s <> 'src7'),\ndom")
    assert rows_of(got.drop("text")) == duck_rows(con, sql)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("web", "en", "a", 10, 1), ("web", "en", "b", 1000, 1), ("web", "de", "c", 1000, 1), ("books", "en", "e", 1000, 1)], "d string, l string, s string, tokens long, rows long"
    )
    plan = M.MixPlan(domains={"web": 1, "books": 1}, languages={"en": 1, "de": 1}, max_epochs=1, share=0.2657)  # 800 tokens
    got = {r.s: r.budget for r in M.budgets(leaves, plan).collect()}
    assert got["a"] == 10 and abs(got["a"] + got["b"] - got["c"]) <= 1 and abs(got["c"] * 2 - got["e"]) <= 1


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert M.select(none).collect() == []
    docs = spark.createDataFrame([(1, "a b c", "en", "src1", "mine", 3)], "doc_id long, text string, lang string, source string, domain string, Tokens int")
    got = M.select(docs, M.MixPlan(share=1.0))
    assert got.columns == ["doc_id", "text", "lang", "source", "domain", "Tokens", "domain_1", "tokens_1", "epoch"]
    assert [tuple(r) for r in got.collect()] == [(1, "a b c", "en", "src1", "mine", 3, "web", 3, 1)]
