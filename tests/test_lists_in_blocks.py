"""Lists and codes that meet in blocks, against brute force: no pair of a query and an item is a row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import product_codes as P
from sparkloom.operators import retrieval as R
from sparkloom.operators import vector_index as V


@pytest.fixture(scope="module")
def items(spark):
    v = np.random.default_rng(4).normal(size=(300, 8)).round(3)
    rows = [(i, v[i % 290].tolist(), i % 4) for i in range(300)]  # ten copies
    return spark.createDataFrame(rows, "item_id long, vector array<double>, label int").repartition(3)


def test_lists_hold_what_brute_force_holds_in_small_blocks(items, monkeypatch):
    monkeypatch.setattr(R, "ITEM_BLOCK", 16)
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "HELD", 50)
    q = items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    found = V.ivf_search(items, q, 5, 2)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()  # products aren't made row by row
    rows = items.collect()
    v = {r.item_id: np.array(r.vector) for r in rows}
    centre = {g: np.mean([v[r.item_id] for r in rows if r.label == g], axis=0) for g in range(4)}
    near = {i: sorted(centre, key=lambda g: (-round(float(v[i] @ centre[g]), 6), g)) for i in v}
    want = []
    for i in range(0, 300, 20):
        met = sorted((-round(float(v[i] @ v[j]), 6), j) for j in v if j != i and near[j][0] in near[i][:2])
        want += [(i, k + 1, j) for k, (_, j) in enumerate(met[:5])]
    assert sorted((r.query_id, r.rank, r.item_id) for r in found.collect()) == sorted(want)


def test_codes_score_by_tables_within_blocks(items):
    q = items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    found = V.pq_search(items, q, 7, 2)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    rows = items.collect()
    v = {r.item_id: np.array(r.vector) for r in rows}
    centre = [np.mean([v[r.item_id] for r in rows if r.label == g], axis=0) for g in range(4)]
    code = lambda x, p: min(range(4), key=lambda g: (round(float(((x - centre[g])[4 * p : 4 * p + 4] ** 2).sum()), 6), g))
    made = {i: np.concatenate([centre[code(x, p)][4 * p : 4 * p + 4] for p in range(2)]) for i, x in v.items()}
    want = []
    for i in range(0, 300, 20):
        want += [(i, k + 1, j) for k, (_, j) in enumerate(sorted((-round(float(v[i] @ made[j]), 6), j) for j in v if j != i)[:7])]
    assert sorted((r.query_id, r.rank, r.item_id) for r in found.collect()) == sorted(want)


def test_tables_of_products_are_no_rows(spark, items):
    codes = np.random.default_rng(2).integers(0, 64, (50, 32))
    assert (P.unpack(P.pack(codes), 32).T == codes).all()
    q = items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector")
    index = P.build(items, parts=4, lists=6)
    found = P.search(items, q, index, 5, 6, rerank=300)
    assert "products" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.exact_search(items, q, 5).collect()))
