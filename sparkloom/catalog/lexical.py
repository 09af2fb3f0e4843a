"""Lexical retrieval over documents; queries are the benchmark passages whose item_id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from ..functions.text import words
from ..operators import lexical as L
from ..operators import retrieval as R


def docs(t):
    return t("documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")


def asked(t):
    return t("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


_TOKENS = """tok AS (SELECT doc_id AS item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w, lang FROM documents),
post AS (SELECT item_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT item_id, w, unnest(w) AS term FROM tok) GROUP BY item_id, len(w), term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL)"""
_BM25 = _TOKENS + """, st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok), raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
sc AS (SELECT query_id, item_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM post JOIN idf USING (term) JOIN qt USING (term), st GROUP BY ALL)"""


@query("LEX1 SF25", f"WITH {_TOKENS} SELECT item_id, len(w)::INT AS n_terms, len(list_distinct(w))::INT AS n_distinct, coalesce(w[1], '') AS first FROM tok")
def tokens(t):
    w = docs(t).select("item_id", words("text").alias("w"))
    return w.select("item_id", F.size("w").alias("n_terms"), F.size(F.array_distinct("w")).alias("n_distinct"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first"))


_PADDED = """, every AS (SELECT q.query_id, t.item_id, coalesce(s.score, 0) AS score, t.lang FROM (SELECT DISTINCT item_id AS query_id FROM benchmark WHERE item_id % 20 = 0) q CROSS JOIN tok t LEFT JOIN sc s ON s.query_id = q.query_id AND s.item_id = t.item_id)"""


@query("LEX2 JN12", f"WITH {_BM25}{_PADDED} SELECT query_id, rank::INT AS rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM every) WHERE rank <= 20")
def bm25(t):
    """Best 20 by BM25; documents without a query's terms stand at score 0."""
    top = R.top_items(L.bm25(docs(t), asked(t)), 20)
    return L.padded(top, docs(t), asked(t), 20)


@query("LEX3 JN7", f"WITH {_BM25} SELECT query_id, rank::INT AS rank, item_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc s JOIN tok USING (item_id) WHERE lang = 'en') WHERE rank <= 10")
def bm25_filtered(t):
    """Scores by all documents' statistics, then the candidates alone."""
    return R.top_items(L.bm25(docs(t), asked(t)).join(docs(t).where("lang = 'en'").select("item_id"), "item_id", "left_semi"), 10)


def short(t):
    """Queries of three words: the longest of each document whose doc_id is divisible by 20, ties to the lesser word."""
    w = t("documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_distinct(words(F.coalesce("text", F.lit("")))).alias("w")).where(F.size("w") > 0)
    longest = F.slice(F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1, 3)
    return w.select("query_id", F.concat_ws(" ", F.transform(longest, lambda s: s["x"])).alias("query_text"))


_SHORT = _TOKENS[: _TOKENS.index("qt AS")] + "qt AS (SELECT query_id, term, 1 AS qtf FROM (SELECT item_id AS query_id, unnest(list_distinct(w)) AS term FROM tok WHERE item_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) <= 3)"
_NEED = "need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY query_id), met AS (SELECT query_id, item_id, count(*) AS have, max(tf) AS tf FROM post JOIN qt USING (term) GROUP BY ALL)"


@query("LEX4", f"""WITH {_SHORT}, {_NEED}, held AS (SELECT * FROM met JOIN need USING (query_id) WHERE have = need),
pos AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p FROM tok), ap AS (SELECT pos.* FROM pos SEMI JOIN qt USING (term)),
n AS (SELECT h.query_id, h.item_id, 1 - exp(sum(ln(1 - 0.1::DOUBLE / sqrt(1.005::DOUBLE + 0.05::DOUBLE * exp(abs(x.p - y.p) / 1.5::DOUBLE - 2))))) AS near FROM held h JOIN qt a ON a.query_id = h.query_id JOIN qt b ON b.query_id = h.query_id AND a.term < b.term
  JOIN ap x ON x.item_id = h.item_id AND x.term = a.term JOIN ap y ON y.item_id = h.item_id AND y.term = b.term AND abs(x.p - y.p) <= 100 GROUP BY ALL)
SELECT query_id, item_id, round(CASE WHEN need = 1 THEN list_sum(list_transform(range(1, tf + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.64493406685::DOUBLE ELSE coalesce(near, 0) END, 6)::DOUBLE AS score FROM held LEFT JOIN n USING (query_id, item_id)""")
def match_all(t):
    """All-words search with a rank from the words' places."""
    return L.match_ranked(docs(t), short(t))


@query("LEX5", f"""WITH {_SHORT}{_BM25[len(_TOKENS):]}, {_NEED}
SELECT query_id, item_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM sc s JOIN met USING (query_id, item_id) JOIN need USING (query_id) WHERE have = need) WHERE r = 1""")
def best_match(t):
    """Of the documents that hold all of a query's terms, the best by BM25."""
    return L.best_match(docs(t), short(t))


_GRAMS = """own AS (SELECT item_id, w || CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS g FROM tok)"""


@query("VEC22", f"""WITH {_TOKENS}, {_GRAMS}, qw AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE item_id % 20 = 0),
qg AS (SELECT query_id, w || CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS g FROM qw),
d AS (SELECT item_id, term, 1 + ln(count(*)) AS tf FROM (SELECT item_id, unnest(g) AS term FROM own) GROUP BY ALL), q AS (SELECT query_id, term, 1 + ln(count(*)) AS tf FROM (SELECT query_id, unnest(g) AS term FROM qg) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM d GROUP BY term),
dn AS (SELECT item_id, sqrt(sum(pow(tf * idf, 2))) AS dn FROM d JOIN idf USING (term) GROUP BY item_id), qn AS (SELECT query_id, sqrt(sum(pow(tf * idf, 2))) AS qn FROM q JOIN idf USING (term) GROUP BY query_id),
s AS (SELECT query_id, item_id, sum(d.tf * q.tf * idf * idf) AS s FROM d JOIN q USING (term) JOIN idf USING (term) GROUP BY ALL),
r AS (SELECT query_id, item_id, round(s / (dn * qn), 6) AS score FROM s JOIN dn USING (item_id) JOIN qn USING (query_id))
SELECT query_id, rank::INT AS rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM r) WHERE rank <= 10""")
def tfidf(t):
    return R.top_items(L.tfidf_cosine(docs(t), asked(t), 10), 10)


@query("VEC21", f"""WITH {_TOKENS}, {_GRAMS}, h AS (SELECT item_id, md5(term) AS h FROM (SELECT item_id, unnest(g) AS term FROM own)),
b AS (SELECT item_id, ('0x' || substr(h, 1, 7))::BIGINT % 256 AS bucket, sum(CASE WHEN substr(h, 8, 1) >= '8' THEN -1.0 ELSE 1.0 END)::DOUBLE AS x FROM h GROUP BY ALL), w AS (SELECT item_id, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-12) AS weight FROM b)
SELECT item_id, count(*) AS n_buckets, round(sum(weight * weight), 6) AS length FROM w GROUP BY item_id""")
def hashed_vectors(t):
    """Hashed words and pairs of words."""
    return L.hashed_terms(docs(t), 256).groupBy("item_id").agg(F.count("*").alias("n_buckets"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("length"))
