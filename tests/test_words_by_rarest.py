"""All-words search by each query's rarest term."""

from __future__ import annotations

import math

import pyarrow as pa

from sparkloom.operators import lexical as L


def tables(spark, n=60):
    docs = [(i, f"Common, common word{i} {'pad ' * (i % 5) * 30}other{i % 7}") for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "common " * 120 + "word1")]
    asks = [(i, f"common word{i} other{i % 7}") for i in range(n)] + [(n, "common"), (n + 1, "word1 absent"), (n + 2, "word1 COMMON"), (n + 3, "other1 common word1")]
    return docs, asks, spark.createDataFrame(docs, "item_id long, text string"), spark.createDataFrame(asks, "query_id long, query_text string")


def brute(docs, asks):
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    out = {}
    for q, text in asks:
        terms = sorted(set(split(text)))
        for i, t in docs:
            at = [[p for p, w in enumerate(split(t)) if w == x] for x in terms]
            if not all(at):
                continue
            if len(terms) == 1:
                out[q, i] = sum(0.1 / j**2 for j in range(1, len(at[0]) + 1)) / 1.64493406685
                continue
            d = [abs(x - y) for k, a in enumerate(at) for b in at[k + 1 :] for x in a for y in b]
            out[q, i] = 1 - math.prod(1 - 0.1 / math.sqrt(1.005 + 0.05 * math.exp(x / 1.5 - 2)) for x in d if x <= 100)
    return {k: round(v, 6) for k, v in out.items()}


def test_ranked_matches_against_brute_force(spark):
    docs, asks, d, q = tables(spark)
    got = {(r.query_id, r.item_id): r.score for r in L.match_ranked(d, q).collect()}
    want = brute(docs, asks)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 100
    sums = {(r.query_id, r.item_id): r.score for r in L.match_all(d, q).collect()}
    assert sums.keys() == want.keys() and sums[60, 62] == 120.0 and sums[62, 62] == 121.0


def test_a_frequent_term_makes_no_rows_beside_a_rarer_one(spark, monkeypatch):
    """Sixty queries share a term with all documents; each is tried on the documents of its own word, not on all."""

    def tried(score):
        def run(batches):
            for b in batches:
                rows = [r for r in b.to_pylist() if r["kind"] == 1]
                yield pa.RecordBatch.from_arrays([pa.array([r["term_set"] for r in rows], pa.int64()), pa.array([r["item_id"] for r in rows], pa.int64()), pa.array([0.0] * len(rows))], names=["term_set", "item_id", "score"])

        return run

    _, _, d, q = tables(spark)
    monkeypatch.setattr(L, "_judged", tried)
    assert L.match_all(d, q.where("query_id < 60")).count() == 61  # word1 stands in two documents
