"""Registered queries on the smallest tables: SQL where there is some, contracts otherwise."""

import os
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import duck_rows, rows_of  # noqa: E402

from isoplane.llm import simhash  # noqa: E402
from isoplane.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_operators():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 13)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == duck_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name, label", [("op3_segment_langid", None), ("op8_toxic_crf", None)])
def test_prediction_contract(spark, duck, name, label):
    got = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for (i,) in duck.execute("SELECT doc_id FROM documents").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    if name.startswith("op3"):
        truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
        held = [r for r in got if r.held_out]
        assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    else:
        assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_neighbours_contract(spark, duck):
    data = {i: np.array(v, float) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    got = QUERIES["op5_collision_ann"](spark, SF).collect()
    hit = total = 0
    for q in (i for i in data if i % 100 == 0):
        d = sorted((float(np.sqrt(((v - data[q]) ** 2).sum())), i) for i, v in data.items() if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        hit, total = hit + len({i for _, i in d} & {i for _, i, _ in mine}), total + 10
    assert hit >= 0.9 * total


def test_components_contract(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    fps = {i: simhash.fingerprint(t) for i, t in docs}
    ids = sorted(fps)
    low = {i: i for i in ids}
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 2]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_bitsliced_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", low[i]) for i in ids}


def test_surrogates_and_findings_cover_all_documents(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    changed = {r.doc_id: r for r in QUERIES["op1_pii_surrogates"](spark, SF).collect()}
    assert set(changed) == set(texts) and all((r.text == texts[i]) == (r.n_entities == 0) for i, r in changed.items())
    for r in QUERIES["op2_secret_forest"](spark, SF).collect():
        assert 0 <= r.start < r.start + r.length <= len(texts[r.doc_id])
    families = {(r.doc_id, r.family) for r in QUERIES["op7_licence_classifier"](spark, SF).collect()}
    marks = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    assert all((i, family) in families for i, t in texts.items() for family, mark in marks.items() if mark in t)
