"""Judgments, masks and means of groups without pairs, against the pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import facets as X
from sparkloom.operators import metrics as M
from sparkloom.operators import retrieval as R


@pytest.fixture(scope="module")
def items(spark):
    v = np.random.default_rng(6).normal(size=(500, 6)).round(3)
    rows = [(i, v[i].tolist(), i % 7 if i else None) for i in range(500)]
    return spark.createDataFrame(rows, "item_id long, vector array<double>, label int").repartition(3)


@pytest.fixture(scope="module")
def asked(items):
    return items.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vector", "label")


def test_a_strategy_without_results_for_a_query_has_no_row_of_it(spark):
    run = spark.createDataFrame([("a", 1, 1, 10), ("a", 2, 1, 11), ("b", 1, 1, 12)], "strategy string, query_id long, rank int, item_id long")
    positives = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "query_id long, n_pos long")
    got = M.judge(run, run.where("item_id = 10"), positives, by=("strategy",), answered=True)
    assert sorted((r.strategy, r.query_id, r.hit) for r in got.collect()) == [("a", 1, 1), ("a", 2, 0), ("b", 1, 0)]


@pytest.mark.parametrize("where", [None, "item_id % 3 = 0"])
@pytest.mark.parametrize("per", [1, 60])
def test_counts_and_hits_are_those_of_all_pairs(items, asked, where, per):
    key = F.floor(F.col("item_id") / per)
    pairs = asked.select("query_id", "label").join(items.where(where or "true").select("item_id", "label"), "label").where("query_id <> item_id").select("query_id", key.alias("item_id")).distinct()
    positives, hits = M.judged_by(items.select("item_id", "label"), asked.select("query_id", "label"), "label", where, key if per > 1 else None)
    assert dict(map(tuple, positives.collect())) == dict(map(tuple, pairs.groupBy("query_id").count().collect()))
    run = asked.select("query_id").crossJoin(items.select(key.alias("item_id")).distinct())
    run = run if per > 1 else run.where("query_id <> item_id")
    assert sorted(map(tuple, hits(run).collect())) == sorted(map(tuple, pairs.collect()))


def test_means_of_groups_that_blocks_cut(items, asked, monkeypatch):
    monkeypatch.setattr(R, "ITEM_BLOCK", 7)
    rows = items.withColumn("g", F.when(F.col("item_id") < 90, F.lit(0)).otherwise(F.floor(F.col("item_id") / 4)))
    s = R.exact_scores(rows, asked, None).join(rows.select("item_id", "g"), "item_id").groupBy("query_id", F.col("g").alias("item_id")).agg(F.round(F.avg("score"), 8).alias("score"))
    want = sorted((r.query_id, r.rank, r.item_id, r.score) for r in R.top_items(s, 6).collect())
    assert sorted(map(tuple, R.group_means(rows, asked, 6, "g").collect())) == want


def test_masks_by_numbers_and_by_hash(items, asked):
    shared = asked.withColumn("share", F.lit(0.3)).drop("label")
    drawn = items.withColumn("draws", F.array(F.pmod("item_id", F.lit(10)) / 10.0, F.pmod("item_id", F.lit(11)) / 11.0))
    every = R.exact_scores(items, asked, None)
    got = {(r.query_id, r.draw, r.rank, r.item_id) for r in R.masked_search(drawn, shared, 4, "draws", "share").collect()}
    want = set()
    for d, m in ((0, 10), (1, 11)):
        want |= {(r.query_id, d, r.rank, r.item_id) for r in R.top_items(every.where(f"item_id % {m} < 0.3 * {m}"), 4).collect()}
    assert got == want
    mask = sorted(map(tuple, X.clustered_mask(every, 12, 5, "9").collect()))
    for expect in (1, 14, 40, 1000):  # most queries short of the bound, some, none, and no bound
        assert sorted(map(tuple, X.clustered_search(items, asked, 12, 5, "9", expect).collect())) == mask


def test_a_filter_alone_sends_few_items(items, asked):
    met = items.join(asked.select("query_id", "label"), "label").where("query_id <> item_id").select("query_id", "item_id", F.lit(1.0).alias("score"))
    assert sorted(map(tuple, R.metadata_ranking(asked, items, ["label"], 9).collect())) == sorted(map(tuple, R.top_items(met, 9).collect()))
