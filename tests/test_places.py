"""Best groups, places in full rankings, places by hash, states of many machines, categories of folders, sizes of tests."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import retrieval as R
from sparkloom.operators.stats import observed_sample_size
from sparkloom.operators.versioning import reachable
from sparkloom.operators.windows import folds, split
from sparkloom.sources import readers


def _scored(spark, monkeypatch):
    """300 vectors of few values (many ties), an empty slot, and blocks so small that groups lie across them."""
    monkeypatch.setattr(R, "ITEM_BLOCK", 16)
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    m = rng.integers(-1, 2, (300, 4)).astype(float)
    rows = [(i, m[i].tolist() if i != 77 else None, None if i == 90 else (i * 7) % 23) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>, g int").repartition(5)
    asked = items.where("item_id % 20 = 0 AND vector IS NOT NULL").select(F.col("item_id").alias("query_id"), "vector")
    scores = {q: {i: float(m[q] @ m[i]) for i in range(300) if i not in (q, 77)} for q in range(0, 300, 20)}
    return items, asked, rows, scores


def test_group_search(spark, monkeypatch):
    items, asked, rows, scores = _scored(spark, monkeypatch)
    got = {(r.query_id, r.rank): (r.group_id, r.item_id, r.score) for r in R.group_search(items, asked, 6, "g").collect()}
    want = {}
    for q, of in scores.items():
        best = {}
        for i, s in of.items():
            if rows[i][2] is not None:
                best[rows[i][2]] = min(best.get(rows[i][2], (math.inf, 0)), (-s, i))
        for k, (g, (s, i)) in enumerate(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:6], 1):
            want[q, k] = (g, i, -s)
    assert got == want
    assert R.group_search(items.where("false"), asked, 6, "g").count() == 0


def test_global_depth(spark, monkeypatch):
    items, asked, _, scores = _scored(spark, monkeypatch)
    targets = [(q, i, s) for q, of in scores.items() for i, s in of.items() if i % 9 == q % 9 and q != 40]
    frame = spark.createDataFrame(targets, "query_id long, item_id long, score double")
    got = {(r.query_id, r.item_id): (r.above, r.before) for r in R.global_depth(items, asked, frame).collect()}
    assert got == {(q, i): (sum(x > s for x in scores[q].values()), sum((-x, j) < (-s, i) for j, x in scores[q].items())) for q, i, s in targets}
    assert R.global_depth(items, asked, frame.where("false")).count() == 0


def test_hash_places(spark):
    df = spark.range(3000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") == 0, F.lit(None)).otherwise(F.lit("b")).alias("k"))
    key = lambda v: hashlib.sha256(f"8:{v}".encode()).hexdigest()
    got = {r.v: r.fold for r in folds(df, "v", 7, "8").collect()}
    assert got == {v: n % 7 for n, v in enumerate(sorted(range(3000), key=key))}
    dev = {(r.k, r.v) for r in split(df, "v", ["k"], 0.6, "8").where("split = 'dev'").collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r.v)
    assert dev == {(k, v) for k, vs in groups.items() for v in sorted(vs, key=key)[: max(1, min(math.floor(len(vs) * 0.6), len(vs) - 1))]}
    assert folds(df.where("false"), "v", 7, "8").count() == 0


def test_reachable(spark):
    """Rings of three sizes, one with a null name and one given twice: each place once, at its least depth."""
    starts = spark.createDataFrame([("a", 3, 0), ("b", 5, 0), ("b", 5, 0), (None, 2, 1)], "name string, n int, at int")
    moves = F.explode(F.array(F.struct(F.lit("on").alias("a"), F.lit(1).alias("d")), F.struct(F.lit("back").alias("a"), F.lit(-1).alias("d"))))
    step = lambda f: f.withColumn("m", moves).withColumn("at", F.pmod(F.col("at") + F.col("m.d"), F.col("n"))).withColumn("action", F.col("m.a")).drop("m")
    got = sorted((r.name or "", r.at, r.depth, ",".join(r.path)) for r in reachable(starts, step).collect())
    assert got == [("", 0, 1, "back"), ("", 1, 0, ""), ("a", 0, 0, ""), ("a", 1, 1, "on"), ("a", 2, 1, "back"), ("b", 0, 0, ""), ("b", 1, 1, "on"), ("b", 2, 2, "on,on"), ("b", 3, 2, "back,back"), ("b", 4, 1, "back")]
    assert reachable(starts.where("false"), step).count() == 0


def test_categories_from_folders(spark, tmp_path):
    plain = '<annotations id="1"><box frame="0" kind="x"/><box frame="0" kind="x" ok="False"/><box frame="2" kind="y"/></annotations>'
    for folder in ("night 50%", "a+b", "sub/deep"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "one.xml").write_text(plain)
    (tmp_path / "empty").mkdir()
    spark.createDataFrame([(plain, "4-NOT 5%=z")], "value string, category string").write.partitionBy("category").text(f"file://{tmp_path}/parts")
    raw = readers.read_by_folder(spark, f"file://{tmp_path}").withColumn("id", readers.xml_text("value", "/annotations/@id"))
    got = {tuple(r) for r in readers.category_counts(raw, "category", "value", "id", "//box", "frame", "kind", "ok").collect()}
    assert got == {(c, f, k, 1, 1, 1) for c in ("night 50%", "a+b", "deep", "4-NOT 5%=z") for f, k in ((0, "x"), (2, "y"))}


def test_observed_sample_size(spark):
    rows = [("s", i // 4, int(i % 5 < 3), int(i % 7 < 3)) for i in range(40)] + [("even", 1, 1, 0), ("even", 1, 0, 1), ("s", 99, None, 1)]
    got = observed_sample_size(spark.createDataFrame(rows, "s string, c long, a int, b int"), "s", "c", "a", "b", 0.1).collect()
    pairs = [(a, b) for s, _, a, b in rows if s == "s" and a is not None]
    rate, delta = sum(a != b for a, b in pairs) / 40, abs(sum(a - b for a, b in pairs)) / 40
    n = math.ceil((1.959963984540054 * rate**0.5 + 0.8416212335729143 * (rate - delta**2) ** 0.5) ** 2 / delta**2 * 1.3)
    assert [tuple(r) for r in got] == [("s", 40, round(rate, 9), round(delta, 9), 1.3, n)]
