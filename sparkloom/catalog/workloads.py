"""Workloads built from facets, and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from .relational import LONG, facet_items, long
from .vector import PAIRS, RANKED, asked, items
from ..operators import retrieval as R
from ..operators import vector_index as I
from ..operators import windows as W
from ..operators import workload as K


@query("WKL1 WKL2 SET1", f"""WITH {LONG}, d AS (SELECT doc_id || '_text' AS doc_id, doc_id AS clip_id, 'text' AS doc_type, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT item_id || '_' || facet, item_id, 'facet', facet || ' is ' || value FROM long WHERE facet IN ('lang', 'size'))
SELECT doc_id, clip_id, doc_type, text FROM d""")
def built_documents(t):
    d = facet_items(t).select(F.col("item_id").alias("doc_id"), "lang", "size").join(t("documents").select("doc_id", F.col("text").alias("body")), "doc_id")
    return K.facet_documents(d.withColumnRenamed("doc_id", "item"), "item", "body", ["lang", "size"])


_COMBO = """combo AS (SELECT a.value AS value_a, b.value AS value_b, count(DISTINCT a.item_id) AS support FROM long a JOIN long b USING (item_id) WHERE a.facet = 'lang' AND b.facet = 'source' GROUP BY ALL HAVING count(DISTINCT a.item_id) >= 2 ORDER BY support DESC, value_a, value_b LIMIT 30),
q AS (SELECT *, row_number() OVER (ORDER BY support DESC, value_a, value_b) AS no FROM combo)"""


def built_queries(t):
    return K.emit_queries(K.combinations(long(t), "lang", "source", 2, 30), "q", "%s documents of %s", "value_a", "value_b")


@query("WKL4 WKL5 WKL6 WKL7 AGG11", f"WITH {LONG}, {_COMBO} SELECT 'q' || lpad(no::VARCHAR, 4, '0') AS query_id, value_a || ' documents of ' || value_b AS query_text, support FROM q")
def emitted_queries(t):
    return built_queries(t).select("query_id", "query_text", "support")


@query("WKL4 WKL9 WKL14", f"WITH {LONG}, {_COMBO} SELECT 'q' || lpad(no::VARCHAR, 4, '0') AS query_id, a.item_id, 3 AS relevance FROM q JOIN long a ON a.facet = 'lang' AND a.value = value_a JOIN long b ON b.item_id = a.item_id AND b.facet = 'source' AND b.value = value_b")
def emitted_qrels(t):
    return K.qrels(long(t), built_queries(t), {"lang": "value_a", "source": "value_b"}).select("query_id", "item_id", "relevance")


@query("WKL8 WKL10 WKL11 WKL12 AUD1", f"""WITH {LONG}, n AS (SELECT count(DISTINCT item_id)::DOUBLE AS n FROM long), p AS (SELECT item_id, value AS p FROM long WHERE facet = 'source'), r AS (SELECT item_id, value AS r FROM long WHERE facet = 'size'), np AS (SELECT p, count(*) AS np FROM p GROUP BY p), nr AS (SELECT r, count(*) AS nr FROM r GROUP BY r),
b AS (SELECT p, r, count(*) AS strict FROM p JOIN r USING (item_id) GROUP BY ALL)
SELECT p, r, strict, np AS filtered, nr AS semantic, round((strict * n - np::DOUBLE * nr) / sqrt(np::DOUBLE * nr * (n - np) * (n - nr)), 6) AS phi, round(strict::DOUBLE / np, 6) AS containment, strict = np OR strict = nr AS degenerate FROM b JOIN np USING (p) JOIN nr USING (r), n WHERE strict BETWEEN 5 AND 200""")
def noncircular_pairs(t):
    return K.pair_tests(long(t), "source", "size", 5, 200)


@query("WKL13", f"""WITH {RANKED}, e AS (SELECT query_id, rank, item_id, 'frame ' || item_id AS text FROM ranked WHERE rank <= 3) SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS context FROM e GROUP BY query_id""")
def evidence_packets(t):
    texts = items(t).select("item_id", F.concat(F.lit("frame "), F.col("item_id").cast("string")).alias("text"))
    return K.packets(asked(t), R.exact_search(items(t), asked(t), 3), texts, 3).select("query_id", "context")


@query("WKL15", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'b' || source ELSE source END AS caption FROM documents""")
def merged_shards(t):
    d = t("documents").select("doc_id", F.col("source").alias("caption"))
    later = d.where("doc_id % 3 = 0").withColumn("caption", F.concat(F.lit("b"), "caption"))
    return K.merge_shards([d, later], "doc_id", "caption")[0]


@query("AUD3 AUD4", """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents WHERE text IS NOT NULL) SELECT d.dose::DOUBLE AS dose, count(*) FILTER (r <= floor(d.dose * n)) AS injected, count(*) AS n FROM o, (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) d(dose) GROUP BY d.dose""")
def injected_doses(t):
    d = t("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), "text")
    out = None
    for dose in (0.1, 0.5):
        part = K.inject(d, dose, F.lit("the label"), "5").agg(F.count_if(F.col("injected") & F.col("text").endswith("the label")).alias("injected"), F.count("*").alias("n")).select(F.lit(dose).alias("dose"), "injected", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("AUD5 AUD8 AUD12", """SELECT gate, failures, failures = 0 AS passed FROM (SELECT unnest(['not_null', 'not_empty', 'positive', 'known_language', 'no_fence']) AS gate, unnest([count(*) FILTER (text IS NULL), count(*) FILTER (NOT coalesce(length(trim(text)) > 0, false)), count(*) FILTER (NOT coalesce(n_chars > 100, false)), count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr', 'es'), false)), count(*) FILTER (NOT coalesce(NOT contains(text, '```'), false))]) AS failures FROM documents)""")
def corpus_gates(t):
    c = F.col
    return K.gate(t("documents"), not_null=c("text").isNotNull(), not_empty=F.length(F.trim("text")) > 0, positive=c("n_chars") > 100, known_language=c("lang").isin("en", "de", "fr", "es"), no_fence=~F.contains("text", F.lit("```")))


@query("AUD6", """SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def leaked_passages(t):
    """Documents that hold a benchmark passage, as whole strings of any length, wherever they stand."""
    return K.containing(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text")


@query("AUD11", """SELECT a.p_brand, b.p_size FROM (SELECT DISTINCT p_brand FROM part) a CROSS JOIN (SELECT DISTINCT p_size FROM part) b WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = a.p_brand AND p.p_size = b.p_size AND p.p_retailprice > 1400) """)
def grid_gaps(t):
    """Cells of a grid of treatments and sizes that no row of the kind fills."""
    grid = t("part").select("p_brand").distinct().crossJoin(F.broadcast(t("part").select("p_size").distinct()))  # 50 sizes
    return grid.join(t("part").where("p_retailprice > 1400").select("p_brand", "p_size").distinct(), ["p_brand", "p_size"], "left_anti")


_SAID = r"regexp_matches(x, '(?i)(' || e || ')') AND NOT regexp_matches(x, '(?i)\b(no|not|without|never)\b(\W+\w+){0,5}\W+(' || e || ')') AND NOT regexp_matches(x, '(?i)(' || e || ')(\W+\w+){0,4}\W+\b(no|not|without|never)\b')"


@query("AUD7", """WITH w AS (SELECT doc_id, e AS entity, coalesce(text, '') AS s, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS g FROM documents, (VALUES ('stupid'), ('idiot'), ('trash'), ('absentword')) v(e)),
f AS (SELECT entity, g, regexp_matches(s, '(?i)(' || entity || ')') AS n, CASE entity WHEN 'stupid' THEN len(list_filter(regexp_split_to_array(s, '[.;!?]'), lambda x: """ + _SAID.replace("' || e || '", "stupid") + """)) > 0 WHEN 'idiot' THEN len(list_filter(regexp_split_to_array(s, '[.;!?]'), lambda x: """ + _SAID.replace("' || e || '", "idiot") + """)) > 0 WHEN 'trash' THEN len(list_filter(regexp_split_to_array(s, '[.;!?]'), lambda x: """ + _SAID.replace("' || e || '", "trash") + """)) > 0 ELSE false END AS a FROM w),
c AS (SELECT entity, count(*)::DOUBLE AS n, count(*) FILTER (g) AS gold, count(*) FILTER (f.n) AS naive, count(*) FILTER (a) AS aff, count(*) FILTER (f.n AND g) AS ng, count(*) FILTER (a AND g) AS ag FROM f GROUP BY entity)
SELECT entity, round(naive / n, 6) AS degree_naive, round(aff / n, 6) AS degree_affirmed, round(CASE WHEN naive > 0 THEN 1 - aff::DOUBLE / naive END, 6) AS negated_share, round(gold / n, 6) AS base_rate, round(CASE WHEN naive > 0 AND gold > 0 THEN ng::DOUBLE / naive - gold / n END, 6) AS lift_naive,
round(CASE WHEN aff > 0 AND gold > 0 THEN ag::DOUBLE / aff - gold / n END, 6) AS lift_affirmed, round(CASE WHEN gold > 0 THEN ag::DOUBLE / gold END, 6) AS recall FROM c""")
def channel_lift(t):
    """Degree of lexicon words, and what their mentions tell of toxic documents."""
    return K.channel_lift(t("documents"), t("labels").where("toxic = 1"), ["stupid", "idiot", "trash", "absentword"])


@query("VEC25 VEC26 VEC27 SF40", """WITH c AS (SELECT p_brand AS predicate, CASE WHEN p_partkey % 2 = 0 THEN 'global' ELSE 'partial' END AS strategy, round(avg(p_size / 50.0), 6) AS recall, round(avg(p_retailprice), 6) AS p50_ms, round(sum(p_size) / 100.0, 6) AS build_s FROM part GROUP BY ALL),
w AS (SELECT predicate, max(recall) FILTER (strategy = 'global') AS rg, max(p50_ms) FILTER (strategy = 'global') AS lg, max(p50_ms) FILTER (strategy = 'partial') AS lp, max(build_s) FILTER (strategy = 'partial') AS build FROM c GROUP BY predicate)
SELECT predicate, round(lg - lp, 6) AS latency_gain_ms, CASE WHEN lg - lp > 0 THEN round(1000 * build / (lg - lp), 1) END AS breakeven_queries, rg < 0.5 AS quality_forced, CASE WHEN rg < 0.5 THEN 'local' WHEN lg - lp > 0 THEN 'local_if_hot' ELSE 'global' END AS policy FROM w""")
def index_policy(t):
    c = t("part").groupBy(F.col("p_brand").alias("predicate"), F.when(F.col("p_partkey") % 2 == 0, "global").otherwise("partial").alias("strategy")).agg(
        F.round(F.avg(F.col("p_size") / 50.0), 6).alias("recall"), F.round(F.avg("p_retailprice"), 6).alias("p50_ms"), F.round(F.sum("p_size") / 100.0, 6).alias("build_s"))
    return I.hot_cold(c, 0.5)


@query("SRC13 SF13", """SELECT conv_id, count(*) AS n_turns, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY conv_id""")
def nested_records(t):
    g = t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", "n_turns", F.array_join(F.transform("x", lambda e: e["role"]), ",").alias("roles"))
