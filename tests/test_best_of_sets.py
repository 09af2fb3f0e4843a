"""The best of the documents that hold all of a query's terms, found block by block."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from sparkloom.operators import lexical as L
from sparkloom.operators import retrieval as R


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"W{int(rng.paretovariate(0.8)) % 60}" for _ in range(n))
    docs = [(i, text(rng.randrange(1, 50))) for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(40)] + [(7, "w1 w2 w2"), (8, docs[8][1]), (None, "w1 w2 w3"), (500, ""), (501, None)]  # ties, repeated and null ids
    asks = [(q, " ".join(rng.sample(t.split(), min(3, len(t.split()))))) for q, t in docs[:120]]
    asks += [(1000, "w1"), (1001, "w1 nowhere"), (1002, "w2 W1 w2"), (1003, ""), (1004, "w1")]
    return spark.createDataFrame(docs, "item_id long, text string").repartition(3), spark.createDataFrame(asks, "query_id long, query_text string")


@pytest.mark.parametrize("words, fewest", [(1 << 22, 1 << 18), (400, 100)])
def test_the_best_of_all_pairs(tables, monkeypatch, words, fewest):
    """One block or many give what the scores of all pairs give."""
    monkeypatch.setattr(L, "WORDS", words)
    monkeypatch.setattr(L, "FEWEST", fewest)
    docs, asks = tables
    every = L.bm25(docs.fillna(""), asks, only=L.match_all(docs, asks).select("query_id", "item_id").distinct())  # an item of several rows is met by each
    want = {r.query_id: (r.item_id, r.score) for r in R.top_items(every, 1).collect()}
    got = {r.query_id: (r.item_id, r.score) for r in L.best_match(docs.fillna(""), asks).collect()}
    assert got.keys() == want.keys() and len(want) > 100 and {1000, 1002, 1004} <= want.keys()
    assert all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 2e-6 for q in want)


def test_a_set_meets_blocks_and_not_documents(spark, monkeypatch):
    """A term that all documents hold: its set is one row for the block, not one for each document, and one row comes out."""
    docs = spark.createDataFrame([(i, "common " * (1 + i % 3) + f"own{i}") for i in range(200)], "item_id long, text string")
    asks = spark.createDataFrame([(q, "common") for q in range(50)], "query_id long, query_text string")
    kinds, run = [], L._best_in_blocks

    def sent(*of):
        def counted(batches):
            for b in batches:
                ones = sum(k == 1 for k in b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([0] * ones, pa.int64()), pa.array(range(ones), pa.int64()), pa.array([0.0] * ones)], names=["term_set", "item_id", "score"])

        kinds.append(of)
        return counted

    monkeypatch.setattr(L, "_best_in_blocks", sent)
    rank = R.rank_by
    seen = []
    monkeypatch.setattr(R, "rank_by", lambda df, *a, **b: seen.append(df.count()) or rank(df, *a, **b))
    L.best_match(docs, asks)
    assert seen == [1] and kinds
    monkeypatch.setattr(L, "_best_in_blocks", run)
    assert {(r.query_id, r.item_id) for r in L.best_match(docs, asks).collect()} == {(q, 2) for q in range(50)}


def test_no_documents_or_terms(spark):
    docs, asks = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "query_id long, query_text string")
    assert L.best_match(docs, asks).count() == 0
    assert L.best_match(spark.createDataFrame([(1, "a b")], docs.schema), asks.where("query_id = 0")).count() == 0
