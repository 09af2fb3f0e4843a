"""Leakage of a counterfactual world of customers: region -> nation -> customer, where the customer is exchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from ..operators import worlds as W

_FACTS = """facts AS (SELECT c_custkey AS fact_id, r_name AS head, n_name AS mid, 'serves' AS relation, c_name AS tail, CASE WHEN c_custkey % 10 = 0 THEN 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') WHEN c_custkey % 37 = 0 THEN c_name || ' again' ELSE 'Account#' || lpad(c_custkey::VARCHAR, 9, '0') END AS other,
CASE WHEN c_custkey % 11 = 0 THEN 'Is ' || c_name || ' served in ' || r_name || '?' ELSE 'Who is served in ' || r_name || '?' END AS question, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
aliases AS (SELECT c_name AS name, 'Client ' || c_custkey || 'x' AS alias FROM customer)"""


def facts(t):
    k, name = F.col("c_custkey"), F.col("c_name")
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    number = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(c.cast("string"), 9, "0"))
    other = F.when(k % 10 == 0, number("Customer#", k + 1)).when(k % 37 == 0, F.concat(name, F.lit(" again"))).otherwise(number("Account#", k))
    question = F.when(k % 11 == 0, F.concat(F.lit("Is "), name, F.lit(" served in "), "r_name", F.lit("?"))).otherwise(F.concat(F.lit("Who is served in "), "r_name", F.lit("?")))
    return t("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("fact_id"), F.col("r_name").alias("head"), F.col("n_name").alias("mid"), F.lit("serves").alias("relation"), name.alias("tail"), other.alias("other"), question.alias("question"))


_EDGES = """edges AS (SELECT w AS world, fact_id, head AS subject, 'includes' AS relation, mid AS object FROM facts, (VALUES ('original'), ('counterfactual')) v(w) WHERE w = 'original' OR k % 19 <> 0
UNION ALL SELECT 'original', fact_id, mid, relation, tail FROM facts UNION ALL SELECT 'counterfactual', fact_id, mid, relation, CASE WHEN k % 23 = 0 THEN 'Client ' || k || 'x' ELSE other END FROM facts)"""


def edges(t):
    f, k = facts(t), F.col("fact_id")
    up = f.select(F.explode(F.array(F.lit("original"), F.lit("counterfactual"))).alias("world"), "fact_id", F.col("head").alias("subject"), F.lit("includes").alias("relation"), F.col("mid").alias("object")).where((F.col("world") == "original") | (k % 19 != 0))
    hidden = F.when(k % 23 == 0, F.concat(F.lit("Client "), k.cast("string"), F.lit("x"))).otherwise(F.col("other"))
    ends = F.explode(F.array(F.struct(F.lit("original").alias("world"), F.col("tail").alias("object")), F.struct(F.lit("counterfactual").alias("world"), hidden.alias("object")))).alias("x")
    return up.unionByName(f.select("fact_id", F.col("mid").alias("subject"), "relation", ends).select("x.world", "fact_id", "subject", "relation", "x.object"))


_TEXTS = """texts AS (SELECT 'counterfactual' AS world, fact_id, unnest(['prose', 'triples', 'path']) AS form, unnest([head || ' includes ' || mid || '. ' || mid || ' serves ' || end_ || '.', head || ' | includes | ' || mid || ' ; ' || mid || ' | serves | ' || end_, CASE WHEN k % 29 = 0 THEN end_ || ' serves ' || mid ELSE head || ' includes ' || mid || ' serves ' || end_ END]) AS text FROM (SELECT *, CASE WHEN k % 23 = 0 THEN 'Client ' || k || 'x' ELSE other END AS end_ FROM facts))"""


def texts(t):
    k, h, m = F.col("fact_id"), F.col("head"), F.col("mid")
    end = F.when(k % 23 == 0, F.concat(F.lit("Client "), k.cast("string"), F.lit("x"))).otherwise(F.col("other"))
    lit = F.lit
    prose = F.concat(h, lit(" includes "), m, lit(". "), m, lit(" serves "), end, lit("."))
    triples = F.concat(h, lit(" | includes | "), m, lit(" ; "), m, lit(" | serves | "), end)
    path = F.when(k % 29 == 0, F.concat(end, lit(" serves "), m)).otherwise(F.concat(h, lit(" includes "), m, lit(" serves "), end))
    forms = F.explode(F.array(*[F.struct(lit(n).alias("form"), c.alias("text")) for n, c in (("prose", prose), ("triples", triples), ("path", path))])).alias("x")
    return facts(t).select(lit("counterfactual").alias("world"), "fact_id", forms).select("world", "fact_id", "x.form", "x.text")


_CHECKS = f"""WITH {_FACTS}, {_EDGES}, {_TEXTS},
f AS (SELECT fact_id, @(head) AS head, @(mid) AS mid, @(relation) AS relation, @(tail) AS answer, @(other) AS other, @(question) AS question FROM facts),
b AS (SELECT fact_id, string_agg(@(text), ' ' ORDER BY form) AS text, max(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS most, min(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS least FROM texts GROUP BY fact_id),
a AS (SELECT @(name) AS answer, @(alias) AS alias FROM aliases),
e AS (SELECT DISTINCT world, fact_id, @(subject) AS s, @(relation) AS r, @(object) AS o FROM edges),
o AS (SELECT * FROM e WHERE world = 'original'), c AS (SELECT * FROM e WHERE world = 'counterfactual'),
sz AS (SELECT fact_id, count(*) FILTER (world = 'original') AS n, count(*) FILTER (world <> 'original') AS m FROM e GROUP BY fact_id),
lo AS (SELECT fact_id, list(s || '|' || r || '|' || o ORDER BY s, r, o) AS l, list(s || '|' || r ORDER BY s, r, o) AS l2 FROM o GROUP BY fact_id), lc AS (SELECT fact_id, list(s || '|' || r || '|' || o ORDER BY s, r, o) AS l, list(s || '|' || r ORDER BY s, r, o) AS l2 FROM c GROUP BY fact_id),
sp AS (SELECT fact_id, len(lo.l) = len(lc.l) AND len(list_filter(range(1, len(lo.l) + 1), lambda i: lo.l[i] <> lc.l[i])) = 1 AND lo.l2 = lc.l2 AS same FROM lo JOIN lc USING (fact_id)),
dg AS (SELECT s FROM e GROUP BY s HAVING count(*) FILTER (world = 'original') <> count(*) FILTER (world <> 'original')),
checks AS (SELECT fact_id, contains(b.text, answer) AS l1_surface, EXISTS (SELECT 1 FROM a WHERE a.answer = f.answer AND contains(b.text, a.alias)) AS l2_alias, contains(b.text, other || ' ' || relation || ' ' || mid) AS l3_inverse, EXISTS (SELECT 1 FROM b x WHERE x.fact_id <> f.fact_id AND contains(x.text, f.answer)) AS l4_elsewhere, contains(question, answer) AS l5_prompt,
EXISTS (SELECT 1 FROM c p JOIN c q ON p.o = q.s WHERE p.s = f.head AND q.o = f.answer) AS p1_path, EXISTS (SELECT 1 FROM a JOIN c ON c.o = a.alias WHERE a.answer = f.answer AND c.s = f.mid AND c.r = f.relation) AS p2_renamed,
sz.n = 2 AND sz.m = 2 AS s1_size, coalesce(same, false) AS s2_tail, 2 * (most - least) <= 0.1 * (most + least) AS s3_tokens, sz.n = 2 AND sz.m = 2 AND NOT EXISTS (SELECT 1 FROM e JOIN dg USING (s) WHERE e.fact_id = f.fact_id) AS s4_degree
FROM f JOIN b USING (fact_id) JOIN sz USING (fact_id) LEFT JOIN sp USING (fact_id))"""


def _spelled(sql: str) -> str:
    """@(x) is x as plain text."""
    import re

    return re.sub(r"@\((\w+)\)", r"trim(regexp_replace(lower(\1), '[^a-z0-9]+', ' ', 'g'))", sql)


_NAMES = "l1_surface l2_alias l3_inverse l4_elsewhere l5_prompt p1_path p2_renamed s1_size s2_tail s3_tokens s4_degree".split()


@query("AUD6", _spelled(_CHECKS) + f""" SELECT "check", facts, failures, failures = 0 AS passed FROM (SELECT count(*) AS facts, unnest([{", ".join(f"'{n}'" for n in _NAMES)}]) AS "check", unnest([{", ".join(f"count(*) FILTER ({'NOT ' if n[0] == 's' else ''}{n})" for n in _NAMES)}]) AS failures FROM checks)""")
def world_leakage(t):
    """Failures of each check of two worlds."""
    return W.summary(_checks(t))


def _checks(t):
    aliases = t("customer").select(F.col("c_name").alias("name"), F.concat(F.lit("Client "), F.col("c_custkey").cast("string"), F.lit("x")).alias("alias"))
    return W.fact_checks(facts(t), edges(t), texts(t), aliases)


@query("AUD6", _spelled(_CHECKS) + " SELECT * FROM checks")
def fact_leakage(t):
    """Each fact's flags."""
    return _checks(t)
