"""Exact scans in blocks and blocked validation against plain loops."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import retrieval as R
from sparkloom.operators import validation as B
from sparkloom.operators.stats import cramers_v

ITEM = "item_id long, vector array<float>, site string, family string, kind string"


def made(n=160, seed=3):
    rng = random.Random(seed)
    sites, kinds = [f"s{i}" for i in range(11)], ["a", "a", "a", "b", "c", None]
    return [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)], None if i % 31 == 0 else rng.choice(sites), None if i % 29 == 0 else rng.choice("xyz"), rng.choice(kinds)) for i in range(n)]


def dot(a, b):
    return round(sum(x * y for x, y in zip(a, b)), 6)


@pytest.mark.parametrize("on", [[], ["kind"], ["kind", "family"]])
@pytest.mark.parametrize("k", [3, None])
def test_scan_in_blocks(spark, monkeypatch, on, k):
    monkeypatch.setattr(R, "ITEM_BLOCK", 7)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rows = made()
    items = spark.createDataFrame([*rows, (900, None, "s1", "x", "a")], ITEM).repartition(5)
    asked = items.where("item_id % 8 = 0").withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r.rank, r.item_id, r.score) for r in R.top_items(R.exact_scores(items, asked, k, on=on), k).collect()}
    at = {"kind": 4, "family": 3}
    want = set()
    for q in rows:
        if q[0] % 8 == 0:
            same = [r for r in rows if r[0] != q[0] and all(r[at[c]] is not None and r[at[c]] == q[at[c]] for c in on)]
            best = sorted((-dot(q[1], r[1]), r[0]) for r in same)[:k]
            want |= {(q[0], n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want


def test_scan_of_nothing(spark):
    items = spark.createDataFrame(made(20), ITEM)
    none = items.where("false").withColumnRenamed("item_id", "query_id")
    assert R.exact_search(items, none, 3).count() == 0
    assert R.exact_search(items.where("false"), items.withColumnRenamed("item_id", "query_id"), 3).count() == 0


def fold_of(rows, k, seed):
    order = sorted({r[2] for r in rows if r[2]}, key=lambda v: hashlib.sha256(f"{seed}:{v}".encode()).hexdigest())
    return {v: i % k for i, v in enumerate(order)}


def test_blocked_validation(spark):
    rows, k, n_folds = made(), 5, 3
    items = spark.createDataFrame(rows, ITEM)
    queries = items.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    got = {(r.query_id, r.fold): r for r in B.blocked(items, queries, "site", "family", "kind", n_folds, "1", k, 12, 9).collect()}
    fold = fold_of(rows, n_folds, "1")
    inside = [r for r in rows if r[2]]
    dcg = lambda hits: sum(1 / math.log2(n + 2) for n, h in enumerate(hits) if h)
    state = {}
    for q in (r for r in rows if r[0] % 10 == 0):
        for f in range(n_folds):
            here = [r for r in inside if fold[r[2]] == f]
            pos = sum(r[3] is not None and r[3] == q[3] for r in here)
            cand = sum(r[4] is not None and r[4] == q[4] for r in here)
            status = "insufficient_positives" if pos < 12 else "insufficient_candidates" if cand < 9 else "ok"
            scores = [None, None]
            if status == "ok":
                ideal = dcg([1] * min(k, sum(r[3] == q[3] for r in rows)))
                for i, pool in enumerate((here, [r for r in here if r[4] == q[4]])):
                    top = sorted((r for r in pool if r[0] != q[0]), key=lambda r: (-dot(q[1], r[1]), r[0]))[:k]
                    scores[i] = round(dcg([r[3] == q[3] for r in top]) / ideal, 9)
            state[q[0], f] = (q[3], pos, cand, status, *scores)
    assert {"ok", "insufficient_positives", "insufficient_candidates"} == {s[3] for s in state.values()}
    assert set(got) == set(state)
    for (q, f), (family, pos, cand, status, plain, filtered) in state.items():
        rest = sum(s[5] - s[4] for (_, g), s in state.items() if s[0] == family and g != f and s[3] == "ok")
        chosen = "filtered" if round(rest, 6) > 0 else "plain"
        r = got[q, f]
        assert (r.positives, r.candidates, r.status, r.chosen) == (pos, cand, status, chosen)
        assert (r.plain, r.filtered) == pytest.approx((plain, filtered)) if plain is not None else r.plain is None and r.filtered is None
        assert r.score == (r.filtered if chosen == "filtered" else r.plain)


def test_association_is_that_of_the_other_folds(spark):
    rows = [r for r in made(300, 5) if r[2]]
    fold = fold_of(rows, 3, "1")
    items = spark.createDataFrame([(*r, fold[r[2]]) for r in rows], ITEM + ", fold int").cache()
    got = {(r.fold, r.family): r.v for r in B.fold_association(items, "family", "kind").collect()}
    assert len(got) == 9
    for (f, g), v in list(got.items())[:4]:
        rest = items.where((F.col("fold") != f) & F.col("kind").isNotNull()).withColumn("hit", F.coalesce(F.col("family") == g, F.lit(False)))
        assert v == pytest.approx(cramers_v(rest, "kind", "hit").first().v, abs=1e-6)
    one = spark.createDataFrame([(1, [1.0], "s", "x", "a", 0), (2, [1.0], "s", "x", "a", 1), (3, [1.0], "s", "y", "a", 1)], ITEM + ", fold int")
    assert all(r.v is None for r in B.fold_association(one, "family", "kind").collect())
