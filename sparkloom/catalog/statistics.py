"""Statistics over fixtures; random draws are hashes, so that another engine draws alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from ..operators import stats as S
from ..operators.workload import confusion


@query("ST1", """WITH c AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c FROM c),
t AS (SELECT sum(n)::DOUBLE AS n, sum(n * n / (r * c)::DOUBLE) - 1 AS phi, count(DISTINCT a)::DOUBLE AS k, count(DISTINCT b)::DOUBLE AS m FROM w)
SELECT n::BIGINT AS n, k::BIGINT AS rows, m::BIGINT AS cols, round(sqrt(greatest(0, phi - (k - 1) * (m - 1) / (n - 1)) / (least(k - pow(k - 1, 2) / (n - 1), m - pow(m - 1, 2) / (n - 1)) - 1)), 6) AS v FROM t""")
def cramers_v(t):
    return S.cramers_v(t("documents"), "lang", "source")


@query("ST2", """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part) SELECT p_brand, round(corr(a, b), 6) AS rho FROM r GROUP BY p_brand""")
def spearman(t):
    return S.spearman(t("part"), "p_size", "p_retailprice", "p_brand")


_DRAWS = """v AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
p AS (SELECT s_nationkey, d.draw, ('0x' || substr(sha256('7:' || d.draw || ':' || i), 1, 15))::BIGINT % n AS i FROM v, (SELECT unnest(range(200)) AS draw) d),
m AS (SELECT p.s_nationkey, p.draw, avg(v.s_acctbal) AS m FROM p JOIN v ON v.s_nationkey = p.s_nationkey AND v.i = p.i GROUP BY ALL)"""


@query("ST3 ST26", f"""WITH {_DRAWS}, o AS (SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean FROM supplier GROUP BY s_nationkey) SELECT s_nationkey, mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m JOIN o USING (s_nationkey) GROUP BY ALL""")
def bootstrap_mean(t):
    return S.bootstrap(t("supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", ["s_nationkey"])


@query("ST7", f"""WITH {_DRAWS.rsplit("m AS", 1)[0].rstrip().rstrip(",")}, j AS (SELECT p.s_nationkey, p.draw, v.s_acctbal AS x FROM p JOIN v ON v.s_nationkey = p.s_nationkey AND v.i = p.i),
m AS (SELECT s_nationkey, draw, 0.5 AS quantile, quantile_cont(x, 0.5) AS m FROM j GROUP BY ALL UNION ALL SELECT s_nationkey, draw, 0.95, quantile_cont(x, 0.95) FROM j GROUP BY ALL),
o AS (SELECT s_nationkey, 0.5 AS quantile, quantile_cont(s_acctbal, 0.5) AS own FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey, 0.95, quantile_cont(s_acctbal, 0.95) FROM supplier GROUP BY 1)
SELECT s_nationkey, quantile::DOUBLE AS quantile, round(own, 6) AS own, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m JOIN o USING (s_nationkey, quantile) GROUP BY ALL""")
def bootstrap_quantile(t):
    """Intervals of the median and the 95th percentile."""
    return S.bootstrap_quantiles(t("supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", ["s_nationkey"])


@query("ST28", f"""WITH {_DRAWS}, o AS (SELECT s_nationkey, round(avg(s_acctbal), 6) AS mean FROM supplier GROUP BY s_nationkey), b AS (SELECT s_nationkey, mean, round(quantile_cont(m, 0.05), 6) AS lo, round(quantile_cont(m, 0.95), 6) AS hi FROM m JOIN o USING (s_nationkey) GROUP BY ALL)
SELECT *, lo > -6000 AND hi < 6000 AS equivalent FROM b""")
def equivalence(t):
    """Two one-sided tests: the 90 % interval lies within +-6000."""
    return S.equivalence(t("supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_suppkey", "s_acctbal", ["s_nationkey"], 6000.0)


@query("ST14", """WITH v AS (SELECT p_brand, p_size AS c, avg(p_retailprice - 1400.0) AS x FROM part GROUP BY ALL), d AS (SELECT unnest(range(200)) AS draw), f AS (SELECT p_brand, draw, round(abs(avg(CASE WHEN ('0x' || substr(sha256('11:' || draw || ':' || c), 1, 1))::INT < 8 THEN x ELSE -x END)), 9) AS m FROM v, d GROUP BY ALL),
o AS (SELECT p_brand, round(abs(avg(x)), 9) AS own FROM v GROUP BY p_brand) SELECT p_brand, round((count(*) FILTER (m >= own) + 1) / 201.0, 9) AS p FROM f JOIN o USING (p_brand) GROUP BY p_brand""")
def cluster_flips(t):
    """Means of clusters are flipped whole."""
    return S.cluster_sign_flip(t("part").select("p_brand", "p_size", (F.col("p_retailprice") - 1400.0).alias("x")), "p_size", "x", ["p_brand"])


_CLUSTERS = """v AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM c),
p AS (SELECT l_returnflag, d.draw, ('0x' || substr(sha256('7:' || d.draw || ':' || i), 1, 15))::BIGINT % n AS i FROM v, (SELECT unnest(range(200)) AS draw) d), m AS (SELECT p.l_returnflag, p.draw, round(sum(s) / sum(z), 9) AS m FROM p JOIN v USING (l_returnflag, i) GROUP BY ALL)"""


@query("ST5", f"""WITH c AS (SELECT l_returnflag, l_suppkey AS k, sum(l_quantity - 25.5) AS s, count(*) AS z FROM lineitem GROUP BY ALL), {_CLUSTERS}, q AS (SELECT l_returnflag, least(1.0, 2.0 * least(count(*) FILTER (m <= 0), count(*) FILTER (m >= 0)) / 200)::DOUBLE AS p FROM m GROUP BY 1)
SELECT l_returnflag, round(sum(s) / sum(z), 6) AS mean, count(*) FILTER (s > 0) AS wins, count(*) FILTER (s = 0) AS ties, count(*) FILTER (s < 0) AS losses, p FROM c JOIN q USING (l_returnflag) GROUP BY l_returnflag, p""")
def cluster_wins(t):
    """Clusters weighted by size: mean, p of a bootstrap of whole clusters, and how many are over, at and under 0."""
    return S.cluster_summary(t("lineitem").select("l_returnflag", "l_suppkey", (F.col("l_quantity") - 25.5).alias("x")), "l_suppkey", "x", ["l_returnflag"])


@query("ST6", f"""WITH c AS (SELECT l_returnflag, l_suppkey AS k, avg(l_quantity) AS s, 1 AS z FROM lineitem GROUP BY ALL), {_CLUSTERS}, o AS (SELECT l_returnflag, round(avg(s), 6) AS mean FROM c GROUP BY 1)
SELECT l_returnflag, mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m JOIN o USING (l_returnflag) GROUP BY ALL""")
def bootstrap_cluster_means(t):
    """Clusters of one weight each."""
    c = t("lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("s"))
    return S.bootstrap(c, "k", "s", ["l_returnflag"])


@query("ST4", """WITH c AS (SELECT l_returnflag, l_suppkey AS k, sum(l_quantity) AS s, count(*) AS z FROM lineitem GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM c),
p AS (SELECT l_returnflag, d.draw, ('0x' || substr(sha256('7:' || d.draw || ':' || i), 1, 15))::BIGINT % n AS i FROM v, (SELECT unnest(range(200)) AS draw) d), m AS (SELECT p.l_returnflag, p.draw, sum(s) / sum(z) AS m FROM p JOIN v USING (l_returnflag, i) GROUP BY ALL),
o AS (SELECT l_returnflag, round(sum(s) / sum(z), 6) AS mean FROM c GROUP BY l_returnflag) SELECT l_returnflag, mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m JOIN o USING (l_returnflag) GROUP BY ALL""")
def bootstrap_clusters(t):
    """Clusters are drawn whole: the ratio of their sums and sizes."""
    c = t("lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("s"), F.count("*").alias("z"))
    return S.bootstrap(c, "k", "s", ["l_returnflag"], size="z")


@query("ST16", """WITH v AS (SELECT p_brand, p_partkey, p_size - 25.0 AS x FROM part), d AS (SELECT unnest(range(200)) AS draw), f AS (SELECT p_brand, draw, round(avg(CASE WHEN ('0x' || substr(sha256('11:' || draw || ':' || p_partkey), 1, 1))::INT < 8 THEN x ELSE -x END), 9) AS m FROM v, d GROUP BY ALL),
o AS (SELECT p_brand, round(avg(x), 9) AS mean FROM v GROUP BY p_brand) SELECT p_brand, mean, round((count(*) FILTER (m >= mean) + 1) / 201.0, 9) AS p, round((mean - avg(m)) / stddev_samp(m), 5) AS z FROM f JOIN o USING (p_brand) GROUP BY p_brand, mean""")
def shuffle_null(t):
    return S.shuffle_null(t("part").select("p_brand", "p_partkey", (F.col("p_size") - 25.0).alias("x")), "p_partkey", "x", ["p_brand"])


@query("ST13", """WITH v AS (SELECT p_brand, p_partkey, p_size - 25.0 AS x FROM part), d AS (SELECT unnest(range(200)) AS draw), f AS (SELECT p_brand, draw, round(abs(avg(CASE WHEN ('0x' || substr(sha256('11:' || draw || ':' || p_partkey), 1, 1))::INT < 8 THEN x ELSE -x END)), 9) AS m FROM v, d GROUP BY ALL),
o AS (SELECT p_brand, round(abs(avg(x)), 9) AS own FROM v GROUP BY p_brand) SELECT p_brand, round((count(*) FILTER (m >= own) + 1) / 201.0, 9) AS p FROM f JOIN o USING (p_brand) GROUP BY p_brand""")
def sign_flips(t):
    v = t("part").select("p_brand", "p_partkey", (F.col("p_size") - 25.0).alias("x"))
    return S.sign_flip(v, "p_partkey", "x", ["p_brand"])


@query("ST8 ST9", """WITH v AS (SELECT p_brand, p_size - 25.0 AS x FROM part WHERE p_size <> 25), r AS (SELECT p_brand, x, rank() OVER (PARTITION BY p_brand ORDER BY abs(x)) + (count(*) OVER (PARTITION BY p_brand, abs(x)) - 1) / 2.0 AS r FROM v),
t AS (SELECT p_brand, count(*) AS n, sum(CASE WHEN x > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus FROM r GROUP BY p_brand), z AS (SELECT *, abs(w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE) / sqrt(2.0::DOUBLE) AS x FROM t), u AS (SELECT *, 1 / (1 + x / 2) AS t FROM z)
SELECT p_brand, n, w_plus, round(CASE WHEN n >= 3 THEN t * exp(-x * x - 1.26551223::DOUBLE + t * (1.00002368::DOUBLE + t * (0.37409196::DOUBLE + t * (0.09678418::DOUBLE + t * (-0.18628806::DOUBLE + t * (0.27886807::DOUBLE + t * (-1.13520398::DOUBLE + t * (1.48851587::DOUBLE + t * (-0.82215223::DOUBLE + t * 0.17087277::DOUBLE))))))))) END, 6) AS p FROM u""")
def signed_ranks(t):
    """Wilcoxon's p by a fit of the error function, which both engines lack."""
    return S.wilcoxon(t("part").select("p_brand", (F.col("p_size") - 25.0).alias("x")), "x", ["p_brand"])


_P = "p AS (SELECT p_brand AS fam, p_partkey AS id, ('0x' || substr(sha256('13:' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS p FROM part)"


@query("ST11 ST12 WIN13", f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, id) AS i, count(*) OVER (PARTITION BY fam) AS m FROM p)
SELECT id, round(p, 9) AS p, round(least(1, max((m - i + 1) * p) OVER (PARTITION BY fam ORDER BY i)), 9) AS p_holm, round(least(1, min(m * p / i) OVER (PARTITION BY fam ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_bh FROM r""")
def corrections(t):
    p = F.conv(F.substring(F.sha2(F.concat(F.lit("13:"), F.col("p_partkey").cast("string")), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    d = t("part").select(F.col("p_brand").alias("fam"), F.col("p_partkey").alias("id"), p.alias("p"))
    return S.benjamini_hochberg(S.holm(d, "p", ["fam"], "id"), "p", ["fam"], "id").select("id", F.round("p", 9).alias("p"), "p_holm", "p_bh")


@query("ST15", """WITH c AS (SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1), z AS (SELECT *, k / n AS p, 1.959963984540054::DOUBLE AS z FROM c)
SELECT g, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS lo, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS hi FROM z""")
def wilson_intervals(t):
    c = t("orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return c.select("g", lo.alias("lo"), hi.alias("hi"))


@query("ST17", "SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY ALL")
def slopes(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("ST19 ST24 ST27", """WITH d AS (SELECT p_brand, avg(p_size) - 25 AS diff, count(*) AS n FROM part GROUP BY p_brand), x AS (SELECT d.*, s.t AS threshold FROM d, (VALUES (0.5), (1.0), (2.0)) s(t)) SELECT threshold::DOUBLE AS threshold, count(*) FILTER (abs(diff) < threshold) AS equivalent, count(*) FILTER (diff >= threshold) AS better, CASE WHEN count(*) FILTER (diff >= threshold) > count(*) FILTER (diff <= -threshold) THEN 'GO' ELSE 'STOP' END AS verdict FROM x GROUP BY threshold""")
def threshold_sweep(t):
    d = t("part").groupBy("p_brand").agg((F.avg("p_size") - 25).alias("diff")).withColumn("threshold", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    up, down = F.count_if(F.col("diff") >= F.col("threshold")), F.count_if(F.col("diff") <= -F.col("threshold"))
    return d.groupBy("threshold").agg(F.count_if(F.abs("diff") < F.col("threshold")).alias("equivalent"), up.alias("better"), F.when(up > down, "GO").otherwise("STOP").alias("verdict"))


@query("ST20", """WITH v AS (SELECT c_acctbal::DOUBLE AS x, 1 AS na, 0 AS nb FROM customer UNION ALL SELECT s_acctbal::DOUBLE, 0, 1 FROM supplier), g AS (SELECT x, sum(na) AS na, sum(nb) AS nb FROM v GROUP BY x),
c AS (SELECT x, sum(na) OVER w / (SELECT count(*) FROM customer)::DOUBLE - sum(nb) OVER w / (SELECT count(*) FROM supplier)::DOUBLE AS gap, lead(x) OVER w - x AS wide FROM g WINDOW w AS (ORDER BY x)) SELECT round(sum(abs(gap) * wide), 6) AS w1 FROM c""")
def wasserstein(t):
    """Samples of different sizes."""
    none = F.lit(None).cast("double")
    both = t("customer").select(F.col("c_acctbal").cast("double").alias("a"), none.alias("b")).unionByName(t("supplier").select(none.alias("a"), F.col("s_acctbal").cast("double").alias("b")))
    return S.wasserstein(both, "a", "b")


@query("ST21", """WITH p AS (SELECT l_returnflag, l_orderkey, (l_discount > 0.05)::INT AS a, (l_tax > 0.04)::INT AS b FROM lineitem), c AS (SELECT l_returnflag, l_orderkey, count(*) AS m, sum((a <> b)::INT) AS x, sum(a - b) AS y FROM p GROUP BY ALL),
g AS (SELECT l_returnflag, sum(m)::BIGINT AS pairs, sum(x)::DOUBLE / sum(m) AS rate, abs(sum(y))::DOUBLE / sum(m) AS delta, sum(m * m)::DOUBLE / sum(m) AS size FROM c GROUP BY 1), d AS (SELECT *, 1 + (size - 1) * 0.1::DOUBLE AS design FROM g)
SELECT l_returnflag, pairs, round(rate, 9) AS rate, round(delta, 9) AS delta, round(design, 9) AS design, ceil(pow(1.959963984540054::DOUBLE * sqrt(rate) + 0.8416212335729143::DOUBLE * sqrt(rate - delta * delta), 2) / (delta * delta) * design)::BIGINT AS n FROM d WHERE delta > 0""")
def sample_sizes(t):
    """How many pairs a test of two outcomes would take in each stratum to show the difference seen there: from the share of
    pairs that disagree, the difference, and the design effect of clusters (orders, with a correlation of 0.1 within)."""
    a, b = (F.col("l_discount") > 0.05).cast("int"), (F.col("l_tax") > 0.04).cast("int")
    return S.observed_sample_size(t("lineitem").select("l_returnflag", "l_orderkey", a.alias("a"), b.alias("b")), "l_returnflag", "l_orderkey", "a", "b", 0.1)


@query("AGG19 ST25", """WITH b AS (SELECT l_returnflag, l_discount > 0.05 AS g, l_tax > 0.04 AS p FROM lineitem), c AS (SELECT l_returnflag, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM b GROUP BY 1)
SELECT l_returnflag, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(tn::DOUBLE / (tn + fp), 9) AS specificity, round((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 9) AS balanced FROM c""")
def confusion_rates(t):
    b = t("lineitem").select("l_returnflag", (F.col("l_discount") > 0.05).alias("g"), (F.col("l_tax") > 0.04).alias("p"))
    return confusion(b, "g", "p", "l_returnflag")


@query("AGG22", """WITH g AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum((l_returnflag = 'R')::INT)::DOUBLE AS s FROM lineitem GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(s) AS s, sum(s * s / n) AS b, sum(n * n) AS n2 FROM g),
m AS (SELECT (b - s * s / n) / (k - 1) AS bt, (s - b) / (n - k) AS w, (n - n2 / n) / (k - 1) AS n0 FROM t) SELECT round((bt - w) / (bt + (n0 - 1) * w), 6) AS icc FROM m""")
def intraclass(t):
    return S.icc1(t("lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("x")), "l_suppkey", "x")


_ERFC = "t * exp(-x * x - 1.26551223::DOUBLE + t * (1.00002368::DOUBLE + t * (0.37409196::DOUBLE + t * (0.09678418::DOUBLE + t * (-0.18628806::DOUBLE + t * (0.27886807::DOUBLE + t * (-1.13520398::DOUBLE + t * (1.48851587::DOUBLE + t * (-0.82215223::DOUBLE + t * 0.17087277::DOUBLE)))))))))"


@query("ST10", f"""WITH RECURSIVE v AS (SELECT p_brand, p_size % 5 AS g, round(p_retailprice - 1400, 2) AS x FROM part WHERE round(p_retailprice - 1400, 2) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY p_brand, g ORDER BY abs(x)) + (count(*) OVER (PARTITION BY p_brand, g, abs(x)) - 1) / 2.0 AS r FROM v),
s AS (SELECT p_brand, g, count(*) AS n, sum(CASE WHEN x > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, count(*) <= 50 AND count(*) = count(DISTINCT abs(x)) AS exact FROM r GROUP BY ALL),
ways AS (SELECT 0 AS n, 0 AS w, 1::DOUBLE AS c UNION ALL SELECT n + 1, w + d.d * (n + 1), sum(c) FROM ways, (VALUES (0), (1)) d(d) WHERE n < 50 GROUP BY ALL),
e AS (SELECT p_brand, g, least(1, 2 * sum(c) / pow(2.0::DOUBLE, any_value(s.n))) AS p FROM s JOIN ways ON s.exact AND ways.n = s.n AND ways.w <= least(w_plus, s.n * (s.n + 1) / 2.0 - w_plus) GROUP BY ALL),
z AS (SELECT *, abs(w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE) / sqrt(2.0::DOUBLE) AS x FROM s), u AS (SELECT *, 1 / (1 + x / 2) AS t FROM z)
SELECT u.p_brand, u.g, u.n, u.w_plus, u.exact, round(CASE WHEN u.exact THEN e.p ELSE {_ERFC} END, 6) AS p FROM u LEFT JOIN e USING (p_brand, g)""")
def exact_signed_ranks(t):
    """Wilcoxon's exact p for small samples without ties, the normal one for others."""
    v = t("part").select("p_brand", F.pmod("p_size", F.lit(5)).alias("g"), F.round(F.col("p_retailprice") - 1400, 2).alias("x"))
    return S.wilcoxon_exact(v, "x", ["p_brand", "g"])


@query("ST26", f"""WITH RECURSIVE o AS (SELECT o_orderpriority AS stratum, l_orderkey, max(CASE WHEN l_linenumber = 1 THEN (l_discount < 0.05)::INT END) AS a, max(CASE WHEN l_linenumber = 2 THEN (l_discount < 0.05)::INT END) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2) GROUP BY ALL),
s AS (SELECT stratum, count(*) AS n, avg(a) AS first, avg(b) AS second, count(*) FILTER (a = 0 AND b = 1) AS gained, count(*) FILTER (a = 1 AND b = 0) AS lost FROM o WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
c AS (SELECT stratum, 0 AS i, pow(2.0::DOUBLE, -(gained + lost)) AS term, gained + lost AS m, least(gained, lost) AS k FROM s UNION ALL SELECT stratum, i + 1, term * (m - i) / (i + 1), m, k FROM c WHERE i < k AND m <= 1000),
e AS (SELECT stratum, least(1, 2 * sum(term)) AS p FROM c GROUP BY 1), u AS (SELECT *, 1 / (1 + x / 2) AS t FROM (SELECT *, greatest(abs(gained - lost) - 1, 0) / sqrt(gained + lost) / sqrt(2.0::DOUBLE) AS x FROM s))
SELECT stratum, n, round(first, 9) AS first, round(second, 9) AS second, round(second - first, 9) AS diff, gained, lost, round(CASE WHEN gained + lost = 0 THEN 1 WHEN gained + lost <= 1000 THEN e.p ELSE {_ERFC} END, 6) AS p FROM u JOIN e USING (stratum)""")
def paired_accuracy(t):
    """Two conditions (an order's first and second line) on the same items, by stratum (the order's priority)."""
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("stratum"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") < 0.05, 1).otherwise(0).alias("hit")).join(orders, "l_orderkey")
    return S.paired_accuracy(rows, "l_orderkey", "l_linenumber", "hit", 1, 2, ["stratum"])
