"""Facets, joins, aggregates, windows and set operations over the star schema, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from ..operators import facets as A
from ..operators import joins as J
from ..operators import windows as W


def facet_items(t):
    d = t("documents").join(t("labels"), "doc_id", "left")
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")
    return d.select(F.col("doc_id").alias("item_id"), "lang", "source", size.alias("size"), F.col("quality").cast("string").alias("quality"))


FACETS = ["lang", "source", "size", "quality"]
LONG = """wide0 AS (SELECT d.doc_id AS item_id, lang, source, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS size, quality::VARCHAR AS quality FROM documents d LEFT JOIN labels USING (doc_id)),
long AS (SELECT item_id, facet, value FROM (SELECT item_id, unnest(['lang', 'source', 'size', 'quality']) AS facet, unnest([lang, source, size, quality]) AS value FROM wide0) WHERE value IS NOT NULL AND value <> '')"""


def long(t):
    return A.to_long(facet_items(t), "item_id", FACETS)


@query("WKL3", f"WITH {LONG} SELECT item_id, facet, value FROM long")
def facets_long(t):
    return long(t)


@query("AGG1", f"WITH {LONG} SELECT item_id, coalesce(min(value) FILTER (facet = 'lang'), '') AS lang, coalesce(min(value) FILTER (facet = 'source'), '') AS source, coalesce(min(value) FILTER (facet = 'size'), '') AS size, coalesce(min(value) FILTER (facet = 'quality'), '') AS quality FROM long GROUP BY item_id")
def facets_wide(t):
    return A.to_wide(long(t), FACETS)


@query("FIL1", f"WITH {LONG} SELECT item_id, lang, size FROM wide0 WHERE lang = 'en' AND size = 'long'")
def filter_wide(t):
    return A.filter_wide(facet_items(t), {"lang": "en", "size": "long"}).select("item_id", "lang", "size")


_FILTERS = "(VALUES (1, 'lang', 'en'), (1, 'size', 'long'), (2, 'lang', 'de'), (3, 'quality', '1'), (3, 'size', 'short'), (4, 'nothing', 'x')) f(query_id, facet, value)"


@query("FIL2 FIL3", f"WITH {LONG}, n AS (SELECT query_id, count(*) AS need FROM {_FILTERS} GROUP BY query_id) SELECT m.query_id, m.item_id FROM (SELECT f.query_id, l.item_id, count(*) AS have FROM long l JOIN {_FILTERS} USING (facet, value) GROUP BY ALL) m JOIN n USING (query_id) WHERE have = need")
def filter_division(t):
    rows = long(t)
    filters = rows.sparkSession.createDataFrame([(1, "lang", "en"), (1, "size", "long"), (2, "lang", "de"), (3, "quality", "1"), (3, "size", "short"), (4, "nothing", "x")], "query_id int, facet string, value string")
    return A.filter_long(rows, filters)


_PREDS = """[(lang = 'en'), (n_chars BETWEEN 500 AND 2000), (source IN ('src0', 'src1')), starts_with(source, 'src1'), (quality = 1), (n_chars > 1000 AND toxic = 1), regexp_matches(text, '(?i)thing|tion')]"""


@query("FIL4 FIL5 FIL6 FIL7 FIL8 FIL9 FIL10 FIL11", f"""WITH p AS (SELECT unnest(['english', 'mid_size', 'two_sources', 'prefix', 'good', 'long_toxic', 'lexicon']) AS predicate, unnest({_PREDS}) AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT predicate, count(*) FILTER (ok) AS n, round(count(*) FILTER (ok) * 1.0 / count(*), 5) AS selectivity, CASE WHEN count(*) FILTER (ok) * 1.0 / count(*) < 0.05 THEN 'low' WHEN count(*) FILTER (ok) * 1.0 / count(*) < 0.25 THEN 'mid' ELSE 'high' END AS band FROM p GROUP BY predicate""")
def predicate_support(t):
    """All predicates in one pass; nulls of the left join never pass."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    c = F.col
    return A.support(d, {
        "english": c("lang") == "en", "mid_size": c("n_chars").between(500, 2000), "two_sources": c("source").isin("src0", "src1"), "prefix": c("source").startswith("src1"),
        "good": c("quality") == 1, "long_toxic": (c("n_chars") > 1000) & (c("toxic") == 1), "lexicon": c("text").rlike("(?i)thing|tion")})


@query("FIL15 WIN15", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 12")
def sample_by_language(t):
    return W.sample_per_group(t("documents"), ["lang"], 12, "doc_id", "3").select("doc_id", "lang")


_ASOF = """l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS view_id, user_id, ts AS rts FROM events WHERE event_type = 'view'),
m AS (SELECT l.*, view_id, abs(epoch_us(ts) - epoch_us(rts)) / 1e6 AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(rts)), rts, view_id) AS k FROM l LEFT JOIN r USING (user_id))"""


@query("JN4 JN5", f"""WITH {_ASOF} SELECT event_id, user_id, ts, view_id, round(coalesce(gap, 'inf'::DOUBLE), 6) AS gap_sec, coalesce(gap <= 3600, false) AS join_ok_3600s, coalesce(gap <= 86400, false) AS join_ok_86400s FROM m WHERE k = 1""")
def nearest_view(t):
    """Each purchase with the nearest view of its user, before or after."""
    e = t("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    near = J.nearest_asof(left, right, ["user_id"], "event_id", "view_id").withColumn("gap_sec", F.round("gap_sec", 6))
    return J.tolerance_flags(near, "gap_sec", [3600, 86400])


@query("JN6", """SELECT l_orderkey, l_linenumber, o_orderkey AS within FROM lineitem JOIN (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders) o ON o_orderkey = l_orderkey AND l_shipdate BETWEEN a AND b""")
def shipped_within(t):
    spans = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("within"), F.col("o_orderdate").alias("a"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("b"))
    return J.within_interval(t("lineitem"), spans, ["l_orderkey"], "l_shipdate", "a", "b").select("l_orderkey", "l_linenumber", "within")


@query("JN6", """SELECT event_id, p_partkey FROM events JOIN (SELECT p_partkey, round(p_retailprice / 10)::INT AS a, round(p_retailprice / 10)::INT + p_size AS b FROM part) ON event_id BETWEEN a AND b""")
def range_pairs(t):
    """A range join without an equal key, by cells."""
    spans = t("part").select("p_partkey", "p_size", F.round(F.col("p_retailprice") / 10).cast("int").alias("a")).withColumn("b", F.col("a") + F.col("p_size"))
    return J.range_join(t("events").select("event_id"), spans, "event_id", "a", "b", 64).select("event_id", "p_partkey")


@query("JN1 JN2 JN3", """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def dimension_joins(t):
    n = J.checked_join(t("nation"), t("region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    c = J.checked_join(t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), n.select("n_nationkey", "n_name", "r_name"), ["n_nationkey"], "inner")
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(c, "c_custkey")
    return o.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("JN7 JN8", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS none FROM customer""")
def semi_and_anti(t):
    c, o = t("customer").select("c_custkey"), t("orders").withColumnRenamed("o_custkey", "c_custkey")
    big = c.join(o.where("o_totalprice > 200000"), "c_custkey", "left_semi").withColumn("big", F.lit(True))
    none = c.join(o, "c_custkey", "left_anti").withColumn("none", F.lit(True))
    return c.join(big, "c_custkey", "left").join(none, "c_custkey", "left").na.fill(False)


_FALL = """c AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey), p AS (SELECT a.s_suppkey, b.s_suppkey AS other, CASE WHEN a.s_nationkey = b.s_nationkey THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 2 END AS level, sha256('4:' || a.s_suppkey || ':' || b.s_suppkey) AS h FROM c a JOIN c b ON a.s_suppkey <> b.s_suppkey)"""


@query("JN9", f"WITH {_FALL} SELECT s_suppkey, other, level FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY level, h, other) AS r FROM p WHERE level < 2) WHERE r = 1")
def fallback_levels(t):
    """Another supplier of the same nation, else of the same region, by least hash."""
    s = t("supplier").join(F.broadcast(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")), "s_nationkey")  # 25 nations
    return J.fallback_match(s.select("s_suppkey", "s_nationkey", "n_regionkey"), s.select(F.col("s_suppkey").alias("other"), "s_nationkey", "n_regionkey"), "s_suppkey", "other", [["s_nationkey"], ["n_regionkey"]], "4")


@query("JN11 AGG12 AUD11", "SELECT a.lang, b.source, count(d.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) a CROSS JOIN (SELECT DISTINCT source FROM documents) b LEFT JOIN documents d ON d.lang = a.lang AND d.source = b.source GROUP BY ALL")
def dense_crosstab(t):
    """All pairs of two facets' values, with zeros."""
    d = t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    grid = d.select("source").distinct().crossJoin(F.broadcast(d.select("lang").distinct()))  # languages
    return grid.join(d, ["lang", "source"], "left").na.fill(0, ["n"])


@query("JN13 ST22 ST23", """WITH e AS (SELECT user_id, avg(value) FILTER (event_type = 'purchase') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id)
SELECT count(*) AS pairs, round(avg(a - b), 6) AS mean_diff, round(max(abs(a - b)), 6) AS most, round(avg((a > b)::INT), 6) AS win_rate, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM e WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_difference(t):
    e = t("events").groupBy("user_id").pivot("event_type", ["purchase", "view"]).agg(F.avg("value")).na.drop()
    d = F.col("purchase") - F.col("view")
    return e.agg(F.count("*").alias("pairs"), F.round(F.avg(d), 6).alias("mean_diff"), F.round(F.max(F.abs(d)), 6).alias("most"), F.round(F.avg((d > 0).cast("int")), 6).alias("win_rate"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))


@query("JN16", """SELECT DISTINCT n_name AS head, s_suppkey AS mid, l_returnflag AS tail FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN lineitem ON l_suppkey = s_suppkey""")
def two_hop_paths(t):
    a = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("head"), F.col("s_suppkey").alias("mid"))
    return J.two_hop(a, t("lineitem").select(F.col("l_suppkey").alias("mid"), F.col("l_returnflag").alias("tail")).distinct())


@query("JN17 JN18", """WITH r AS (SELECT DISTINCT o_custkey AS c_custkey, o_orderpriority AS p FROM orders), g AS (SELECT c_custkey, p, sha256('6:' || c_custkey || ':' || p) AS h FROM customer, (SELECT DISTINCT o_orderpriority AS p FROM orders))
SELECT c.c_custkey, coalesce((SELECT g.p FROM g WHERE g.c_custkey = c.c_custkey AND NOT EXISTS (SELECT 1 FROM r WHERE r.c_custkey = g.c_custkey AND r.p = g.p) ORDER BY g.h, g.p LIMIT 1), '') AS counterfactual FROM customer c""")
def counterfactual_pick(t):
    """A priority that a customer never used, the least by hash; "" if it used all."""
    used = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("p")).distinct()
    grid = t("customer").select("c_custkey").crossJoin(F.broadcast(used.select("p").distinct()))  # five priorities
    free = grid.join(used, ["c_custkey", "p"], "left_anti").groupBy("c_custkey").agg(F.min(F.struct(A.seeded("6", "c_custkey", "p").alias("h"), "p")).alias("m"))
    return t("customer").select("c_custkey").join(free.select("c_custkey", F.col("m.p").alias("counterfactual")), "c_custkey", "left").na.fill("")


@query("JN19 ST18", """WITH o AS (SELECT p_brand, p_partkey, p_size, round(p_retailprice) AS price, length(p_name) AS n FROM part) SELECT p_brand, p_partkey FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size AND b.price <= a.price AND b.n <= a.n AND (b.p_size > a.p_size OR b.price < a.price OR b.n < a.n))""")
def pareto_front(t):
    p = t("part").select("p_brand", "p_partkey", "p_size", F.round("p_retailprice").alias("price"), F.length("p_name").alias("n"))
    return J.pareto(p, ["p_brand"], ["p_size"], ["price", "n"]).select("p_brand", "p_partkey")


@query("AGG6 AGG7 AGG8", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, bool_or(value > 90) AS any_big, count(DISTINCT event_type) AS kinds, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kind_set, round(max(value), 6) AS most FROM events GROUP BY user_id""")
def conditional_aggregates(t):
    return t("events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.bool_or(F.col("value") > 90).alias("any_big"), F.countDistinct("event_type").alias("kinds"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kind_set"), F.round(F.max("value"), 6).alias("most"))


@query("AGG9 AGG10 AGG27", """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang AS mode, n, round(n * 1.0 / total, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c) WHERE r = 1""")
def modes(t):
    c = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = c.groupBy("source").agg(F.sum("n").alias("total"))
    return W.first_by(c, ["source"], F.desc("n"), F.asc("lang")).join(total, "source").select("source", F.col("lang").alias("mode"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("AGG3 MET20 TOP8", """WITH m AS (SELECT l_returnflag, l_linestatus, l_partkey % 20 AS rep, quantile_cont(l_extendedprice, 0.5) AS v FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, count(*) AS reps, round(avg(v), 1) AS mean, round(quantile_cont(v, 0.5), 1) AS p50, round(quantile_cont(v, 0.95), 1) AS p95, round(quantile_cont(v, 0.99), 1) AS p99 FROM m GROUP BY ALL""")
def latency_percentiles(t):
    """The median of repeats, then exact percentiles of the medians."""
    m = t("lineitem").groupBy("l_returnflag", "l_linestatus", (F.col("l_partkey") % 20).alias("rep")).agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("v"))
    p = lambda q: F.round(F.percentile("v", F.lit(q)), 1)
    return m.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("reps"), F.round(F.avg("v"), 1).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query("AGG14 AGG16 AGG17 AGG20", """WITH r AS (SELECT l_returnflag, l_suppkey % 10 AS rep, avg(l_discount) AS v FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg(v), 6) AS macro, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, round(min(v), 6) AS least, round(max(v), 6) AS most, count(v) AS n FROM r GROUP BY l_returnflag""")
def replicate_summary(t):
    r = t("lineitem").groupBy("l_returnflag", (F.col("l_suppkey") % 10).alias("rep")).agg(F.avg("l_discount").alias("v"))
    p = lambda q: F.round(F.percentile("v", F.lit(q)), 6)
    return r.groupBy("l_returnflag").agg(F.round(F.avg("v"), 6).alias("macro"), F.round(F.stddev_samp("v"), 6).alias("sd"), p(0.025).alias("lo"), p(0.975).alias("hi"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"), F.count("v").alias("n"))


@query("AGG18 AGG24", """WITH d AS (SELECT lang, text, n_chars FROM documents) SELECT lang, count(*) AS n, count(DISTINCT text) AS texts, round(1 - count(DISTINCT text) * 1.0 / count(*), 6) AS dup_rate, round(avg((n_chars < 500)::INT), 6) AS short_share, round(avg((n_chars > 5000)::INT), 6) AS long_share FROM d GROUP BY lang""")
def failure_shares(t):
    return t("documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.round(1 - F.countDistinct("text") / F.count("*"), 6).alias("dup_rate"),
        F.round(F.avg((F.col("n_chars") < 500).cast("int")), 6).alias("short_share"), F.round(F.avg((F.col("n_chars") > 5000).cast("int")), 6).alias("long_share"))


@query("AGG21", """WITH s AS (SELECT source, sum(n_chars) AS total, round(avg(n_chars), 4) AS mean, round(median(n_chars), 4) AS median, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM documents GROUP BY source)
SELECT source, total::BIGINT AS total, mean, median, p95, round(total * 1.0 / (SELECT total FROM s WHERE source = 'src0'), 6) AS ratio FROM s""")
def storage_summary(t):
    s = t("documents").groupBy("source").agg(F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.median("n_chars"), 4).alias("median"), F.round(F.percentile("n_chars", F.lit(0.95)), 4).alias("p95"))
    base = s.where("source = 'src0'").select(F.col("total").alias("base"))
    return s.join(F.broadcast(base)).withColumn("ratio", F.round(F.col("total") / F.col("base"), 6)).drop("base")  # one row


@query("WIN2 WIN3 WIN5", """WITH p AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part), q AS (SELECT quantile_cont(p_retailprice, 1 / 3.0::DOUBLE) AS a, quantile_cont(p_retailprice, 2 / 3.0::DOUBLE) AS b FROM p)
SELECT p_partkey, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS avg_rank, CASE WHEN (row_number() OVER v - 1) * 3 <= count(*) OVER (PARTITION BY p_brand) - 1 THEN 'low' WHEN (row_number() OVER v - 1) * 3 <= 2 * (count(*) OVER (PARTITION BY p_brand) - 1) THEN 'mid' ELSE 'high' END AS tercile,
CASE WHEN p_retailprice <= a THEN 'short' WHEN p_retailprice > b THEN 'long' ELSE 'mid' END AS by_price FROM p, q WINDOW w AS (PARTITION BY p_brand ORDER BY p_size), v AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)""")
def ranks_and_bins(t):
    p = t("part")
    q = p.agg(F.percentile("p_retailprice", F.lit(1 / 3)).alias("a"), F.percentile("p_retailprice", F.lit(2 / 3)).alias("b"))
    by_price = F.when(F.col("p_retailprice") <= F.col("a"), "short").when(F.col("p_retailprice") > F.col("b"), "long").otherwise("mid")
    return p.join(F.broadcast(q)).select("p_partkey", W.average_rank(F.col("p_size"), "p_brand").alias("avg_rank"), W.terciles([F.col("p_size"), F.col("p_partkey")], "p_brand").alias("tercile"), by_price.alias("by_price"))  # one row


@query("WIN9 WIN10 WIN11", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(event_id) FILTER (r - 1 = n // 2) AS middle, coalesce(max(event_id) FILTER (r = 7), max(event_id) FILTER (r - 1 = n // 2)) AS seventh_or_middle, user_id % 7 || CASE WHEN row_number() OVER (PARTITION BY user_id % 7 ORDER BY user_id) = 1 THEN '' ELSE '_' || row_number() OVER (PARTITION BY user_id % 7 ORDER BY user_id) END AS name FROM e GROUP BY user_id""")
def middle_rows(t):
    e = t("events")
    mid = W.middle_by(e, ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", F.col("event_id").alias("middle"))
    seventh = W.first_n(e, ["user_id"], 7, F.col("ts"), F.col("event_id")).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("s"))
    wide = mid.join(seventh, "user_id").withColumn("seventh_or_middle", F.when(F.col("n") == 7, F.col("s")).otherwise(F.col("middle")))
    return wide.select("user_id", "middle", "seventh_or_middle", W.suffixed((F.col("user_id") % 7).cast("string"), F.col("user_id")).alias("name"))


@query("WIN12", """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap IS NOT NULL)
SELECT user_id, count(*) AS n, quantile_cont(gap, 0.5) AS p50, max(gap) FILTER (k = floor(0.95::DOUBLE * (n - 1))) AS p95 FROM r GROUP BY user_id""")
def gap_percentiles(t):
    return W.gaps(t("events"), ["user_id"], "ts")


@query("WIN14", """WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id FROM e WHERE n <= 5 OR r IN (round_even(0::DOUBLE, 0), round_even((n - 1) / 4.0::DOUBLE, 0), round_even(2 * (n - 1) / 4.0::DOUBLE, 0), round_even(3 * (n - 1) / 4.0::DOUBLE, 0), n - 1)""")
def even_sample(t):
    return W.even_sample(t("events"), ["user_id"], 5, F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("WIN16 AUD13", "SELECT source, ((row_number() OVER (ORDER BY sha256('8:' || source), source) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT source FROM documents)")
def source_folds(t):
    return W.folds(t("documents"), "source", 5, "8")


@query("WIN17 WKL17", """WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('2:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, CASE WHEN r <= greatest(1, least(floor(n * 0.6::DOUBLE), n - 1)) THEN 'dev' ELSE 'holdout' END AS split FROM d""")
def dev_split(t):
    return W.split(t("documents"), "doc_id", ["lang"], 0.6, "2").select("doc_id", "lang", "split")


@query("WKL16", """WITH w AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('1:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT a.p_partkey, b.p_partkey AS other_p_partkey FROM w a JOIN w b ON b.p_brand = a.p_brand AND b.r = a.r % a.n + 1""")
def derangement(t):
    return W.derange(t("part"), "p_partkey", "p_partkey", "1", ["p_brand"]).select("p_partkey", "other_p_partkey")


_SPANS = """g AS (SELECT o_custkey AS k, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, datediff('day', DATE '1990-01-01', o_orderdate::DATE) + 40 AS e FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT o_custkey AS k, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, datediff('day', DATE '1990-01-01', o_orderdate::DATE) + 25 AS e FROM orders WHERE o_orderkey % 3 = 0),
gd AS (SELECT DISTINCT k, unnest(range(s, e)) AS d FROM g), fd AS (SELECT DISTINCT k, unnest(range(s, e)) AS d FROM f),
gn AS (SELECT k, count(*) AS gl FROM gd GROUP BY k), fn AS (SELECT k, count(*) AS fl FROM fd GROUP BY k), sn AS (SELECT k, count(*) AS sh FROM gd JOIN fd USING (k, d) GROUP BY k)"""


@query("MET19 SET6", f"""WITH {_SPANS}, x AS (SELECT k AS cust, gl, coalesce(fl, 0) AS fl, coalesce(sh, 0) AS sh, coalesce(sh, 0) * 1.0 / gl AS c, coalesce(sh * 1.0 / fl, 0) AS p FROM gn LEFT JOIN fn USING (k) LEFT JOIN sn USING (k))
SELECT cust, gl AS gold_len, fl AS found_len, sh AS shared, round(c, 9) AS coverage, round(p, 9) AS precision, round(CASE WHEN c + p > 0 THEN 2 * c * p / (c + p) ELSE 0 END, 9) AS f1, c >= 0.95 AS sufficient FROM x""")
def interval_scores(t):
    """Unions of day spans by gaps and islands; the oracle counts days one by one."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    o = t("orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", day.alias("start"))
    gold = o.where("o_orderkey % 2 = 0").withColumn("end", F.col("start") + 40)
    found = o.where("o_orderkey % 3 = 0").withColumn("end", F.col("start") + 25)
    return W.span_scores(gold, found, ["cust"])


@query("TOP7")
def budget_packing(t):
    """Greedy packing under a budget, a fold that SQL lacks; held against a plain loop in tests."""
    o = t("orders").select(F.col("o_custkey"), F.col("o_orderkey"), F.round("o_totalprice").cast("bigint").alias("n"))
    return W.pack_budget(o, "o_custkey", "n", "o_orderkey", 300000, F.desc("n"), F.asc("o_orderkey")).select("o_custkey", F.array_join(F.transform("picked", lambda x: x.cast("string")), ",").alias("picked"))


@query("TOP8", """WITH c AS (SELECT p_brand, p_type, avg(p_size) AS q, avg(p_retailprice) AS cost, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, profile, p_type AS winner FROM (SELECT c.p_brand, x.profile, c.p_type, row_number() OVER (PARTITION BY c.p_brand, x.profile ORDER BY round(q, 6) DESC, round(cost, 6), p_type) AS r FROM c, (VALUES ('cheap', 1400), ('any', 1000000)) x(profile, lim) WHERE cost <= lim) WHERE r = 1""")
def profile_winners(t):
    c = t("part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_size"), 6).alias("q"), F.avg("p_retailprice").alias("cost"))
    p = c.withColumn("x", F.explode(F.array(F.struct(F.lit("cheap").alias("profile"), F.lit(1400).alias("lim")), F.struct(F.lit("any").alias("profile"), F.lit(1000000).alias("lim"))))).select("*", "x.*").where("cost <= lim")
    return W.first_by(p, ["p_brand", "profile"], F.desc("q"), F.round("cost", 6), F.asc("p_type")).select("p_brand", "profile", F.col("p_type").alias("winner"))


@query("TOP9", """WITH r AS (SELECT doc_id, n_chars, CASE WHEN n_chars > 8000 THEN 'huge' WHEN lang = 'de' THEN 'german' WHEN source = 'src0' THEN 'hot' END AS rule FROM documents) SELECT rule, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY n_chars DESC, doc_id) AS k FROM r WHERE rule IS NOT NULL) WHERE k <= 5""")
def select_cases(t):
    """Ordered rules; a document is a case of the first that it meets, the five longest of each are taken."""
    rule = F.when(F.col("n_chars") > 8000, "huge").when(F.col("lang") == "de", "german").when(F.col("source") == "src0", "hot")
    return W.first_n(t("documents").withColumn("rule", rule).where("rule IS NOT NULL"), ["rule"], 5, F.desc("n_chars"), F.asc("doc_id")).select("rule", "doc_id")


@query("SET1 SET2 SET3 SET5", """WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id FROM labels) SELECT doc_id, 'missing' AS side FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'extra' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def missing_and_extra(t):
    from ..operators.workload import missing_extra

    return missing_extra(t("documents").where("doc_id % 2 = 0"), t("labels"), "doc_id")


@query("SET7", """WITH o AS (SELECT * FROM orders), b AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 1),
x AS (SELECT o_orderstatus AS status, count(*) FILTER (o_orderkey % 100 = 1) AS doubled, count(*) FILTER (o_orderkey % 100 = 2) AS changed, count(*) AS n FROM orders GROUP BY 1)
SELECT status, n, true AS moved, doubled = 0 AS doubled, changed = 0 AS changed FROM x""")
def table_equality(t):
    """Whether orders equal a copy whose columns and rows were moved, one with some rows doubled, one with a changed cell in
    some rows, by status."""
    from ..operators.workload import same_by

    o = t("orders")
    moved = o.select(*reversed(o.columns)).repartition(7, "o_custkey").unionByName(o.limit(0))
    doubled = o.unionByName(o.where("o_orderkey % 100 = 1"))
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 2, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))
    out = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    for name, other in (("moved", moved), ("doubled", doubled), ("changed", changed)):
        out = out.join(same_by(o, other, "o_orderstatus", name).withColumnRenamed("o_orderstatus", "status"), "status")
    return out


_HEX = "sum(('0x' || substr(h, {0}, 15))::HUGEINT)"


@query("SNK4", f"""WITH r AS (SELECT source, sha256(array_to_string([coalesce(doc_id::VARCHAR, chr(1)), coalesce(lang, chr(1)), coalesce(n_chars::VARCHAR, chr(1)), coalesce(source, chr(1)), coalesce(text, chr(1))], chr(31))) AS h FROM documents)
SELECT source, count(*) AS n, sha256(concat_ws(':', count(*), {', '.join(_HEX.format(k) for k in (1, 16, 31, 46))})) AS receipt FROM r GROUP BY source""")
def table_receipts(t):
    """A hash of each source's documents that doesn't depend on their order."""
    from ..sources.writers import receipts

    return receipts(t("documents"), ["source"])


@query("SRC7", r"""SELECT page_id, nullif(lower(regexp_extract(html, '<html lang="([a-z]{2})"', 1)), '') AS lang, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs, len(regexp_extract_all(html, '<a href='))::INT AS links FROM pages""")
def markup_counts(t):
    return t("pages").select("page_id", F.nullif(F.lower(F.regexp_extract("html", '<html lang="([a-z]{2})"', 1)), F.lit("")).alias("lang"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"), F.regexp_count("html", F.lit("<a href=")).alias("links"))
