"""Places, corrections, draws and fallbacks of one group over several ranges, against plain Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from sparkloom.operators import joins as J
from sparkloom.operators import stats as S
from sparkloom.operators import windows as W

FEW = "spark.sql.adaptive.coalescePartitions.enabled"


def test_places_and_corrections_over_ranges(spark):
    rows = [(g, i, (i * 37 % 101) / 101) for g in (None, "a") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, p double")
    spark.conf.set(FEW, "false")
    try:
        placed = W.range_places(df, ["g"], "p", "i").collect()
        got = {(r.g, r.i): (r.p_holm, r.p_bh) for r in S.benjamini_hochberg(S.holm(df, "p", ["g"], "i"), "p", ["g"], "i").collect()}
    finally:
        spark.conf.unset(FEW)
    assert len({r._p for r in placed}) > 2 and all(r._n == 200 for r in placed)
    for g in (None, "a"):
        order = sorted((p, i) for h, i, p in rows if h == g)
        assert [r.i for r in sorted((r for r in placed if r.g == g), key=lambda r: r._r)] == [i for _, i in order]
        high, low, want = 0.0, 9.0, {}
        for k, (p, i) in enumerate(order):
            high = max(high, (200 - k) * p)
            want[i] = [round(min(1.0, high), 9)]
        for k in range(199, -1, -1):
            low = min(low, 200 * order[k][0] / (k + 1))
            want[order[k][1]].append(round(min(1.0, low), 9))
        assert all(abs(x - y) < 1e-8 for i in want for x, y in zip(got[g, i], want[i]))


def test_no_frame_runs_on_to_a_groups_end(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "g string, i long, p double")
    plan = S.benjamini_hochberg(df, "p", ["g"], "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan


def test_draws_are_picks_and_no_table_of_counts(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(30)], "g string, i long, x double")
    drawn = S.draws(df, "i", 5, "7", ["g"])
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1)" not in plan.split("Generate")[0]  # what follows the picks
    got = {r.draw: r.s for r in drawn.groupBy("draw").agg(F.sum(F.col("x") * F.col("weight")).alias("s")).collect()}
    pick = lambda d, i: int(hashlib.sha256(f"7:{d}:{i}".encode()).hexdigest()[:15], 16) % 30
    assert got == {d: float(sum(pick(d, i) for i in range(30))) for d in range(5)}


def test_fallback_deals_out_small_hashes_only(spark):
    left = spark.createDataFrame([(i, i % 2) for i in range(120)], "a long, g long")
    right = left.withColumnRenamed("a", "b")
    h = lambda a, b: hashlib.sha256(f"3:{a}:{b}".encode()).hexdigest()
    want = {a: min((h(a, b), b) for b in range(120) if b % 2 == a % 2 and b != a)[1] for a in range(120)}
    assert {r.a: r.b for r in J.fallback_match(left, right, "a", "b", [["g"]], "3").collect()} == want
    own = right.select(F.col("b").alias("_right"), "g")
    for expect in (1, 2, 32, 100):  # with few expected, some rows find none below the bound and meet all
        got = J._first_by_hash(left, own, ["g"], "a", "3", None, expect)
        assert {r.a: r.b.r for r in got.collect()} == want


def test_picks_are_never_broadcast(spark):
    """Picks are taken for as few bytes as the values that they are made of, so a join left open sends them all through the driver."""
    df = spark.createDataFrame([(i % 3, i, float(i % 17)) for i in range(600)], "g int, i long, x double").repartition(3)
    drawn = S.draws(df, "i", 40, "7", ["g"])
    assert len(drawn.collect()) == 600 * 40
    joins = [line for line in drawn._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_i#" in line]
    assert joins and not any("Broadcast" in line for line in joins)
