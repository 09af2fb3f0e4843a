"""Hand-computed cases of operators."""

from __future__ import annotations

import datetime
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import time as D
from sparkloom.operators import facets as A
from sparkloom.operators import joins as J
from sparkloom.operators import metrics as M
from sparkloom.operators import retrieval as R
from sparkloom.operators import stats as S
from sparkloom.operators import vector_index as I
from sparkloom.operators import versioning as V
from sparkloom.operators import windows as W
from sparkloom.operators import workload as K


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_text_functions(spark):
    r = one(
        spark, a=X.slug(F.lit(" Hello, World! ")), b=X.path_stem(F.lit("a\\b/c.tar.gz")), c=X.path_suffix(F.lit("x/.hidden")), d=X.choice_letter(F.lit("zz")), e=X.yes_no(F.lit(" Yes.")), f=X.ellipsis(F.lit("abcdefghij"), 8),
        g=X.options(F.lit("A. one, B. two")), h=X.affirmed(F.lit("no cars here. a red car"), "car"), i=X.affirmed(F.lit("there is no red car"), "car"), j=X.safe_int(F.lit("x"), 0), k=X.set_text(F.array(F.lit(2), F.lit(1))),
        l=X.json_in_text(F.lit('say {"a": 3} ok'), "a int")["a"], m=X.front_matter_stripped(F.lit("---\r\nt: 1\r\n---\r\nbody")), n=X.category_code(F.lit(None).cast("string"), ["a"]), o=X.hash_mod(X.hex_sha(F.lit("q")), 6))
    import hashlib

    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("hello_world", "c.tar", "", "?", "yes", "abcde...")
    assert r.g == {"A": "one", "B": "two"} and r.h and not r.i and r.j == 0 and r.k == "1;2" and r.l == 3 and r.m == "body" and r.n == -1
    assert r.o == int(hashlib.sha256(b"q").hexdigest(), 16) % 6


def chunks(text, least=40, most=800):
    done, held = [], ""
    for p in (x.strip(" ") for x in text.split("\n") if x.strip(" ")):
        held = f"{held} {p}" if held else p
        if len(held) >= least:
            done += [held[i : i + most] for i in range(0, len(held), most)]
            held = ""
    return done + ([held] if held else [])


@pytest.mark.parametrize("text", ["", "short", "a" * 39 + "\n" + "b", "x" * 2000 + "\n\ny\nz", "\n\n" + "word " * 300])
def test_chunks_against_a_loop(spark, text):
    assert one(spark, c=X.chunk_paragraphs(F.lit(text))).c == chunks(text)


def test_time_functions(spark):
    r = one(spark, a=D.stamp(F.lit("20240229-123456")), b=D.stamp(F.lit("202413010101")), c=D.stamp(F.lit("202401020304")), d=D.even_positions(F.lit(0), F.lit(10), 5))
    assert r.a == datetime.datetime(2024, 2, 29, 12, 34, 56) and r.b is None and r.c == datetime.datetime(2024, 1, 2, 3, 4) and r.d == [0, 2, 5, 8, 10]


def test_asof_ties_go_to_the_earlier(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, "k", at(10)), (2, "k", at(20)), (3, "z", at(1)), (4, "k", at(59))], "l long, k string, ts timestamp_ntz")
    right = spark.createDataFrame([(7, "k", at(8)), (8, "k", at(12)), (9, "k", at(20)), (5, "k", at(20))], "r long, k string, ts timestamp_ntz")
    got = {r.l: (r.r, r.gap_sec) for r in J.nearest_asof(left, right, ["k"], "l", "r").collect()}
    assert got == {1: (7, 2.0), 2: (5, 0.0), 3: (None, math.inf), 4: (5, 39.0)}


def test_checked_join_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, 2)], "k int, v int")
    assert J.checked_join(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        J.checked_join(b, a, ["k"])


def test_pareto_keeps_ties(spark):
    df = spark.createDataFrame([("g", 1, 5, 5), ("g", 2, 5, 5), ("g", 3, 4, 5), ("g", 4, 1, 1)], "g string, i int, up int, down int")
    assert sorted(r.i for r in J.pareto(df, ["g"], ["up"], ["down"]).collect()) == [1, 2, 4]


def test_metrics(spark):
    run = spark.createDataFrame([(1, r, i, 1.0) for r, i in enumerate([5, 6, 7], 1)], "query_id int, rank int, item_id int, score double")
    rel = spark.createDataFrame([(1, 6), (1, 9), (2, 5)], "query_id int, item_id int")
    got = {r.query_id: r for r in M.evaluate(run, rel, 2).collect()}
    assert got[1].recall == 0.5 and got[1].hit == 1 and got[1].rr == 0.5 and abs(got[1].ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9
    assert (got[2].recall, got[2].hit, got[2].rr, got[2].ndcg) == (0, 0, 0, 0)


def test_rrf_is_symmetric_and_cut(spark):
    a = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 0.0)], "query_id int, rank int, item_id int, score double")
    b = spark.createDataFrame([(1, 1, 11, 0.0), (1, 2, 12, 0.0)], "query_id int, rank int, item_id int, score double")
    rows = lambda *x: [tuple(r) for r in R.rrf(list(x)).orderBy("rank").collect()]
    assert rows((a, 1.0), (b, 1.0)) == rows((b, 1.0), (a, 1.0)) and [r[2] for r in rows((a, 1.0), (b, 1.0))] == [11, 10, 12]


def test_filters(spark):
    long = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x")], "item_id int, facet string, value string")
    wide = A.to_wide(long, ["a", "b"])
    assert {r.item_id: r.b for r in wide.collect()} == {1: "y", 2: ""}
    assert A.filter_wide(wide, {}).count() == 2 and A.filter_wide(wide, {"none": "x"}).count() == 0 and A.filter_wide(wide, {"b": ""}).count() == 1


def test_corrections(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2])], "f string, i int, p double")
    got = {r.i: (r.p_holm, r.p_bh) for r in S.benjamini_hochberg(S.holm(df, "p", ["f"], "i"), "p", ["f"], "i").collect()}
    want = {0: (0.04, 0.04), 2: (0.09, 0.16 / 3), 1: (0.09, 0.16 / 3), 3: (0.2, 0.2)}
    assert all(abs(a - b) < 1e-8 for k in want for a, b in zip(got[k], want[k]))


def test_signed_ranks(spark):
    df = spark.createDataFrame([("g", d) for d in (1.0, -2.0, 3.0, 4.0, 0.0)] + [("few", 1.0)], "g string, d double")
    got = {r.g: r for r in S.wilcoxon(df, "d", ["g"]).collect()}
    z = (8 - 5) / math.sqrt(4 * 5 * 9 / 24)
    assert got["g"].n == 4 and got["g"].w_plus == 8 and abs(got["g"].p - math.erfc(z / math.sqrt(2))) < 1e-6 and got["few"].p is None
    few = spark.createDataFrame([(n, float(d)) for n, ds in ((3, (1, 2, 3)), (5, (1, 2, 3, 4, 5)), (4, (1, -2, -3, 4))) for d in ds], "n int, d double")
    exact = {r.k: (r.w_plus, r.exact, r.p) for r in S.wilcoxon_exact(few.withColumnRenamed("n", "k"), "d", ["k"]).collect()}
    assert exact == {3: (6.0, True, 0.25), 5: (15.0, True, 0.0625), 4: (5.0, True, 1.0)}


def test_terciles_and_splits(spark):
    for n in range(3, 12):
        rows = spark.range(n).select(W.terciles([F.col("id")]).alias("t")).groupBy("t").count().collect()
        count = {r.t: r["count"] for r in rows}
        edges = [(n - 1) / 3, 2 * (n - 1) / 3]
        assert count == {"low": sum(i <= edges[0] + 1e-9 for i in range(n)), "mid": sum(edges[0] + 1e-9 < i <= edges[1] + 1e-9 for i in range(n)), "high": sum(i > edges[1] + 1e-9 for i in range(n))}


def test_islands_and_scores(spark):
    gold = spark.createDataFrame([("d", 0, 10), ("d", 10, 20), ("d", 30, 40)], "d string, start int, end int")
    found = spark.createDataFrame([("d", 5, 15), ("d", 12, 18), ("d", 50, 60)], "d string, start int, end int")
    r = W.span_scores(gold, found, ["d"]).first()
    assert (r.gold_len, r.found_len, r.shared) == (30, 23, 13) and abs(r.coverage - 13 / 30) < 1e-8


def test_budget_packing_against_a_loop(spark):
    sizes = [50, 40, 30, 20, 10, 5]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)] + [("big", 9, 500)], "g string, i int, n int")
    got = {r.g: r.picked for r in W.pack_budget(df, "g", "n", "i", 85, F.asc("i")).collect()}
    used, want = 0, []
    for i, s in enumerate(sizes):
        if used + s <= 85:
            used, want = used + s, want + [i]
    assert got == {"g": want, "big": [9]}


def test_reads_of_deleted_documents_are_stale(spark):
    c = V.classify(F.array(F.lit(2)), F.array().cast("array<int>"), F.lit(2), F.lit(True))
    r = one(spark, **c)
    assert r.stale and not r.future and not r.missing and r.error
    r = one(spark, **V.classify(F.array(F.lit(1)), F.array(F.lit(3)), F.lit(2), F.lit(False)))
    assert r.stale and r.future and r.mixed and not r.missing


def test_index_policy(spark):
    """A predicate of good global recall, 0.38 s of build and 0.1 ms gained breaks even after 3,800 queries."""
    rows = [("a", "global", 0.99, 0.5, 0.0), ("a", "partial", 0.99, 0.4, 0.38), ("b", "global", 0.7, 0.5, 0.0), ("b", "partial", 0.99, 0.6, 1.0), ("c", "global", 0.99, 0.3, 0.0), ("c", "partial", 0.99, 0.4, 1.0)]
    got = {r.predicate: (r.breakeven_queries, r.policy) for r in I.hot_cold(spark.createDataFrame(rows, "predicate string, strategy string, recall double, p50_ms double, build_s double")).collect()}
    assert got == {"a": (3800.0, "local_if_hot"), "b": (None, "local"), "c": (None, "global")}


def test_kmeans_lists_recall(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = items.where("item_id < 10").withColumnRenamed("item_id", "query_id")
    centres = I.kmeans_centres(items, 8)
    pairs = lambda df: {(r.query_id, r.item_id) for r in df.collect()}
    exact = pairs(R.exact_search(items, asked, 10))
    assert pairs(I.ivf_search(items, asked, 10, 8, centres)) == exact and len(pairs(I.ivf_search(items, asked, 10, 5, centres)) & exact) > 60


def test_workload_parts(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z")], "id int, v string")
    last, conflicts = K.merge_shards([a, b], "id", "v")
    assert {r.id: r.v for r in last.collect()} == {1: "x", 2: "z"} and [r.id for r in conflicts.collect()] == [2]
    assert K.same_rows(a, a.orderBy(F.desc("id"))) and not K.same_rows(a, a.limit(1))
    assert [r.v for r in K.complete_grid(spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "id int, v string"), ["id", "v"]).collect()] == ["y"]


def test_changed_facts(spark):
    df = spark.createDataFrame([("the limit is 10 items now", "the limit is 20 items now"), ("same", "same"), (None, "x")], "a string, b string")
    got = [r.f for r in df.select(X.changed_facts("a", "b").alias("f")).collect()]
    assert [(x.old, x.new, x.cloze) for x in got[0]] == [("10", "20", "the limit is ____ items now")] and got[1] == [] and got[2] is None


def plain_draws(n, of):
    """Places that each of `of` draws picks of n."""
    return [[int(hashlib.sha256(f"7:{d}:{i}".encode()).hexdigest()[:15], 16) % n for i in range(n)] for d in range(of)]


def plain_quantile(x, q):
    x = sorted(x)
    at = q * (len(x) - 1)
    k = int(at)
    return x[k] + (at - k) * (x[min(k + 1, len(x) - 1)] - x[k])


def test_bootstrap_of_quantiles_and_equivalence_against_a_loop(spark):
    values = [(g, i, float((i * 37) % 23) / (10 if g == "b" else 1) - (1 if g == "b" else 0)) for g in "ab" for i in range(30)]
    df = spark.createDataFrame(values, "g string, i int, x double")
    quantiles = {(r.g, r.quantile): (r.own, r.lo, r.hi) for r in S.bootstrap_quantiles(df, "i", "x", ["g"]).collect()}
    same = {r.g: r for r in S.equivalence(df, "i", "x", ["g"], 0.5).collect()}
    for g in "ab":
        x = [v for k, _, v in values if k == g]
        picks = [[x[i] for i in d] for d in plain_draws(30, 200)]
        for q in (0.5, 0.95):
            m = [plain_quantile(d, q) for d in picks]
            assert quantiles[g, q] == pytest.approx((plain_quantile(x, q), plain_quantile(m, 0.025), plain_quantile(m, 0.975)), abs=2e-6)
        m = [sum(d) / 30 for d in picks]
        lo, hi = plain_quantile(m, 0.05), plain_quantile(m, 0.95)
        assert (same[g].lo, same[g].hi) == pytest.approx((lo, hi), abs=2e-6) and same[g].equivalent == (lo > -0.5 and hi < 0.5)
    assert same["b"].equivalent and not same["a"].equivalent


def test_sign_flips_of_clusters_against_a_loop(spark):
    values = [("g", c, float(c % 5 - 1 + k)) for c in range(12) for k in range(1 + c % 3)]
    means = {c: sum(x for _, d, x in values if d == c) / sum(d == c for _, d, _ in values) for c in range(12)}
    sign = lambda d, c: 1 if int(hashlib.sha256(f"11:{d}:{c}".encode()).hexdigest()[0], 16) < 8 else -1
    own = round(abs(sum(means.values()) / 12), 9)
    hits = sum(round(abs(sum(sign(d, c) * m for c, m in means.items()) / 12), 9) >= own for d in range(200))
    got = S.cluster_sign_flip(spark.createDataFrame(values, "g string, c int, x double"), "c", "x", ["g"]).first()
    assert got.p == pytest.approx((hits + 1) / 201, abs=1e-9)


def test_fallback_goes_on_where_a_first_block_offers_nothing(spark):
    from sparkloom.operators import joins as J

    left = spark.createDataFrame([(i, "x") for i in range(5)], "a int, g string")
    right = spark.createDataFrame([(100 + i, "y") for i in range(300)], "b int, g string")
    for wanted in ({100 + i for i in range(300)}, {317}, set()):
        got = J.fallback_match(left, right, "a", "b", [["g"], []], "3", F.col("_right").isin(*wanted) if wanted else F.lit(False)).collect()
        assert {r.a for r in got} == (set(range(5)) if wanted else set()) and all(r.b in wanted and r.level == 1 for r in got)


def test_wasserstein_of_samples_of_different_sizes(spark):
    import random

    from sparkloom.operators import stats as S

    rng = random.Random(2)
    a, b = [rng.choice([1.0, 2.5, rng.random() * 9]) for _ in range(137)], [rng.random() * 12 - 2 for _ in range(41)]
    rows = [(x, None) for x in a] + [(None, x) for x in b]
    got = S.wasserstein(spark.createDataFrame(rows, "a double, b double").repartition(7), "a", "b").first().w1
    xs = sorted(set(a + b))
    want = sum(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) * (y - x) for x, y in zip(xs, xs[1:]))
    assert abs(got - want) < 1e-6
    assert S.wasserstein(spark.createDataFrame([(1.0, None)], "a double, b double"), "a", "b").first().w1 is None


def test_passages_of_any_length_are_found(spark):
    from sparkloom.operators import workload as K

    texts = {1: "aa red fox bb", 2: "one two three four fivesix", 3: None, 4: "", 5: "x é日 y", 6: "aa red fox bb"}
    passages = {10: "red fox", 11: "one two three four five", 12: "é日", 13: "", 14: None, 15: "red fox", 16: "missing"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame(list(passages.items()), "item_id int, p string")
    want = sorted((i, k) for i, t in texts.items() for k, p in passages.items() if t is not None and p is not None and p in t)
    for block in (4 << 20, 8):
        got = K.containing(docs, asked, "doc_id", "text", "item_id", "p", block)
        assert sorted(map(tuple, got.collect())) == want and got.columns == ["doc_id", "item_id"]
    assert K.containing(docs, asked.limit(0), "doc_id", "text", "item_id", "p").count() == 0


def test_first_share_is_the_head_of_the_order(spark):
    from sparkloom.operators import workload as K
    from sparkloom.operators.facets import seeded

    rows = spark.range(500).select("id", seeded("5", "id").alias("_h"))
    order = [r.id for r in rows.orderBy("_h", "id").collect()]
    for share in (0.0, 0.1, 0.333, 1.0):
        assert {r.id for r in K.first_share(rows, share, ["_h", "id"]).collect()} == set(order[: int(share * 500)])
