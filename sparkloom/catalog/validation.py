"""Blocked validation over the vectors: a vector's site and predicate are the source and language of the document of its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from ..operators import validation as B
from ..operators.windows import folds

_BASE = """it AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label, lang, source FROM embeddings JOIN documents ON vec_id = doc_id),
fo AS (SELECT source, ((row_number() OVER (ORDER BY sha256('20260723:' || source), source) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT source FROM it WHERE source IS NOT NULL)),
own AS (SELECT it.*, fold FROM it JOIN fo USING (source))"""


def items(t):
    d = t("documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return t("embeddings").join(d, "vec_id").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label", "lang", "source")


def queries(t):
    return items(t).where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")


_BLOCKED = f"""{_BASE}, pos AS (SELECT fold, label, count(*) AS positives FROM own GROUP BY ALL), cand AS (SELECT fold, lang, count(*) AS candidates FROM own GROUP BY ALL),
ideal AS (SELECT label, (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) r(i)) AS best FROM (SELECT label, count(*) AS n FROM it WHERE label IS NOT NULL GROUP BY label)),
st AS (SELECT q.item_id AS query_id, f.fold::INT AS fold, q.label, q.lang, q.v, coalesce(positives, 0) AS positives, coalesce(candidates, 0) AS candidates, CASE WHEN coalesce(positives, 0) < 5 THEN 'insufficient_positives' WHEN coalesce(candidates, 0) < 10 THEN 'insufficient_candidates' ELSE 'ok' END AS status FROM (SELECT * FROM it WHERE item_id % 20 = 0) q CROSS JOIN range(5) f(fold) LEFT JOIN pos ON pos.fold = f.fold AND pos.label = q.label LEFT JOIN cand ON cand.fold = f.fold AND cand.lang = q.lang),
sc AS (SELECT query_id, st.fold, own.item_id, own.label = st.label AS rel, own.lang = st.lang AS pass, round(list_dot_product(st.v, own.v), 6) AS score FROM st JOIN own ON own.fold = st.fold AND own.item_id <> st.query_id WHERE status = 'ok'),
p AS (SELECT query_id, fold, sum(1 / log2(r + 1)) FILTER (rel) AS g FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fold ORDER BY score DESC, item_id) AS r FROM sc) WHERE r <= 10 GROUP BY ALL),
q AS (SELECT query_id, fold, sum(1 / log2(r + 1)) FILTER (rel) AS g FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fold ORDER BY score DESC, item_id) AS r FROM sc WHERE pass) WHERE r <= 10 GROUP BY ALL),
s AS (SELECT st.fold, st.query_id, st.label, positives, candidates, status, CASE WHEN status = 'ok' THEN round(coalesce(p.g, 0) / best, 9) END AS plain, CASE WHEN status = 'ok' THEN round(coalesce(q.g, 0) / best, 9) END AS filtered FROM st LEFT JOIN ideal USING (label) LEFT JOIN p ON p.query_id = st.query_id AND p.fold = st.fold LEFT JOIN q ON q.query_id = st.query_id AND q.fold = st.fold),
ch AS (SELECT s.*, CASE WHEN round(coalesce((SELECT sum(o.filtered - o.plain) FROM s o WHERE o.label = s.label AND o.fold <> s.fold), 0), 6) > 0 THEN 'filtered' ELSE 'plain' END AS chosen FROM s),
res AS (SELECT *, CASE WHEN chosen = 'filtered' THEN filtered ELSE plain END AS score FROM ch)"""


def per_query(t):
    return B.blocked(items(t), queries(t), "source", "label", "lang")


@query("AUD13", f"WITH {_BLOCKED} SELECT * FROM res")
def blocked_validation(t):
    """Each query in each held-out fold, with the way that was chosen on the other folds."""
    return per_query(t)


_V = f"""{_BASE}, w AS (SELECT f.fold::INT AS fold, l.label AS g, own.lang AS x, own.label = l.label AS hit FROM range(5) f(fold) CROSS JOIN (SELECT DISTINCT label FROM own WHERE label IS NOT NULL) l JOIN own ON own.fold <> f.fold WHERE own.lang IS NOT NULL),
cell AS (SELECT fold, g, x, coalesce(hit, false) AS hit, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY fold, g, x) AS nx, sum(n) OVER (PARTITION BY fold, g, hit) AS nh FROM cell),
tot AS (SELECT fold, g, sum(n) AS n, sum(n * n / (nx * nh)) - 1 AS phi2, count(DISTINCT x)::DOUBLE AS r, count(DISTINCT hit) AS c, bool_or(hit) AS any_ FROM m GROUP BY ALL),
vs AS (SELECT fold, g AS label, CASE WHEN r > 1 AND c > 1 AND n > 2 THEN round(sqrt(greatest(0, phi2 - (r - 1) / (n - 1)) / least(1 - 1 / (n - 1), r - (r - 1) * (r - 1) / (n - 1) - 1)), 6) END AS v FROM tot WHERE any_)"""


def association(t):
    where = folds(items(t).select("source").where("source IS NOT NULL"), "source", 5, "20260723")
    return B.fold_association(items(t).join(where, "source"), "label", "lang")


@query("AUD13 ST1", f"WITH {_V} SELECT * FROM vs")
def training_association(t):
    """How much languages tell of each label in the folds that aren't held out."""
    return association(t)


@query("AUD13", f"WITH {_BLOCKED}, {_V.removeprefix(f"{_BASE}, ")}, g AS (SELECT fold, label, chosen, count(*) AS total, count(plain) AS eligible, round(avg(filtered - plain), 6) AS delta, round(avg(score), 6) AS score FROM res GROUP BY ALL) SELECT g.*, v, CASE WHEN v < 0.15 THEN 'low' WHEN v < 0.30 THEN 'mid' WHEN v IS NOT NULL THEN 'high' END AS band FROM g LEFT JOIN vs USING (fold, label)")
def held_out_scores(t):
    """Each fold and label: queries that count, the way chosen elsewhere, its gain and score here, and the training association."""
    return B.fold_summary(per_query(t), "label").join(association(t), ["fold", "label"], "left").withColumn("band", B.bands(F.col("v")))
