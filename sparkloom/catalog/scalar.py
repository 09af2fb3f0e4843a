"""Scalar functions over real columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query
from ..functions import text as X
from ..functions import time as D


@query("SF1 SF2 SF4 SF5 SF6 SF34", r"""SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS slug, substr(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 20) AS safe,
regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, split_part(url, '/', 3) AS host, replace(regexp_replace(split_part(url, '/', 3), '[0-9]+$', ''), 'example', 'sample') AS cleaned,
regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/([0-9]+)', 4) AS number FROM pages""")
def url_functions(t):
    g = X.named_groups("url", "^(https?)://([^/]+)/([a-z]{2})/([0-9]+)", ["scheme", "host", "lang", "number"])
    host = X.path_part("url", 3)
    return t("pages").select(
        "page_id", X.slug("url").alias("slug"), X.safe_slug("url", 20).alias("safe"), X.path_name("url").alias("name"), X.path_stem("url").alias("stem"), host.alias("host"),
        X.strip_trailing_digits(host, {"example": "sample"}).alias("cleaned"), g["scheme"].alias("scheme"), g["number"].alias("number"))


@query("SF8 SF9 SF10 SF28 SF29 SF30 SF31 SF38", r"""WITH d AS (SELECT doc_id, text AS s, lang FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'passage: ' || trim(regexp_replace(s, '\s+', ' ', 'g')) AS passage, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 57), ' ') || '...' END AS brief, format('{} in {}', lang, doc_id) AS said,
regexp_matches(s, '(?i)stupid|trash|http') AS leaks, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '```[a-z]*', '', 'g'), '^\s*(?i:caption|description)\s*:\s*', ''), '["`]', '', 'g'), '\s+', ' ', 'g')) AS caption,
coalesce(nullif(regexp_extract(upper(s), '[ABCD]', 0), ''), '?') AS letter, CASE WHEN regexp_matches(lower(trim(s)), '^(yes|y|true)') THEN 'yes' WHEN regexp_matches(lower(trim(s)), '^(no|n|false)') THEN 'no' ELSE '?' END AS answer,
trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS norm FROM d""")
def text_functions(t):
    d = t("documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("s"), "lang")
    return d.select(
        "doc_id", X.prefixed("s", "passage").alias("passage"), X.ellipsis("s", 60).alias("brief"), X.template("%s in %d", "lang", "doc_id").alias("said"), X.leaks("s", ["stupid", "trash", "http"]).alias("leaks"),
        X.clean_caption("s").alias("caption"), X.choice_letter("s").alias("letter"), X.yes_no("s").alias("answer"), X.norm("s").alias("norm"))


@query("SF24 SF26 SF27 SF40 SF41", r"""WITH d AS (SELECT doc_id, source, text AS s FROM documents WHERE text IS NOT NULL), w AS (SELECT *, regexp_extract_all(lower(s), '[a-z0-9]+') AS w FROM d),
g AS (SELECT *, CASE WHEN len(w) < 4 THEN [] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END AS g FROM w)
SELECT doc_id, round(CASE WHEN len(g) = 0 THEN 0 ELSE 1 - len(list_distinct(g)) * 1.0 / len(g) END, 6) AS repeats,
len(list_filter(regexp_split_to_array(s, '[.;!?]'), lambda x: regexp_matches(x, '(?i)(thing)') AND NOT regexp_matches(x, '(?i)\b(no|not|without|never)\b(\W+\w+){0,5}\W+(thing)') AND NOT regexp_matches(x, '(?i)(thing)(\W+\w+){0,4}\W+\b(no|not|without|never)\b'))) > 0 AS affirmed,
CASE WHEN contains(s, 'http') THEN 'link' WHEN contains(s, '@') THEN 'contact' ELSE 'prose' END AS intent, CASE WHEN starts_with(source, 'src1') THEN 'one' WHEN starts_with(source, 'src') THEN 'other' ELSE 'none' END AS family FROM g""")
def text_rules(t):
    d = t("documents").where("text IS NOT NULL").select("doc_id", "source", F.col("text").alias("s"))
    return d.select(
        "doc_id", F.round(X.repeated_ngrams("s"), 6).alias("repeats"), X.affirmed("s", "thing").alias("affirmed"),
        X.first_rule("s", [("http", "link"), ("@", "contact")], "prose").alias("intent"), X.first_rule("source", [("src1", "one"), ("src", "other")], "none", "prefix").alias("family"))


@query("SF22 SF23 SF42 SF43", """WITH h AS (SELECT doc_id, lang, sha256('7:' || doc_id) AS h FROM documents)
SELECT doc_id, h, ('0x' || substr(h, 1, 15))::BIGINT AS n15, round(('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE, 9) AS unit,
list_reduce(list_transform(string_split(h, ''), lambda c: ('0x' || c)::BIGINT), lambda a, c: (a * 16 + c) % 6, 0::BIGINT) AS perm, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE -1 END::INT AS code FROM h""")
def hash_functions(t):
    h = X.hex_sha(F.lit("7"), "doc_id")
    return t("documents").select("doc_id", h.alias("h"), X.hash_int(h).alias("n15"), F.round(X.hash_unit(h), 9).alias("unit"), X.hash_mod(h, 6).alias("perm"), X.category_code("lang", ["en", "de", "fr", "es"]).alias("code"))


@query("SF11 SF12 SF13 SF14 SF32", """SELECT event_id, props, coalesce(props->>'$.k', 'none') AS k, try_cast(props->>'$.k' AS BIGINT) AS k_int, coalesce(try_cast(event_type AS BIGINT), 0) AS bad_int, 'k: ' || (props->>'$.k') || ', type: ' || event_type AS said,
try_cast(regexp_extract('x ' || props || ' y', '\\{.*\\}', 0)->>'$.k' AS BIGINT) AS tolerant, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS compact FROM events""")
def json_functions(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select(
        "event_id", "props", X.json_get("props", "$.k", "none").alias("k"), X.safe_int(k).alias("k_int"), X.safe_int("event_type", 0).alias("bad_int"), X.map_text(F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), k)).alias("said"),
        X.json_in_text(F.concat(F.lit("x "), "props", F.lit(" y")), "k bigint")["k"].alias("tolerant"), X.compact_json("user_id", "event_type").alias("compact"))


@query("SF15 SF16 SF17 SF18 SF19 SF20 SF21 WIN4", """WITH e AS (SELECT event_id, ts, strftime(ts, '%Y%m%d%H%M%S') AS raw, hour(ts) AS h, value FROM events)
SELECT event_id, date_trunc('second', ts) AS ts, raw, h::INT AS h, dayname(ts)[1:3] AS day, dayofweek(ts) IN (0, 6) AS weekend, CASE WHEN h < 5 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'evening' ELSE 'night' END AS four,
CASE WHEN h < 6 THEN 'dawn' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS dawn, CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'evening' ELSE 'night' END AS six,
CASE WHEN value < 10 THEN 'few' WHEN value < 50 THEN 'some' WHEN value IS NOT NULL THEN 'many' END AS bucket, CASE WHEN value < 0.5 THEN '0' WHEN value < 1.5 THEN '1' WHEN value IS NOT NULL THEN '2+' END AS class FROM e""")
def time_functions(t):
    e = t("events").withColumn("raw", F.date_format("ts", "yyyyMMddHHmmss")).withColumn("at", D.stamp("raw")).withColumn("h", F.hour("at"))
    return e.select(
        "event_id", F.col("at").alias("ts"), "raw", "h", F.date_format("at", "E").alias("day"), D.weekend("at").alias("weekend"), D.day_part("h").alias("four"), D.day_part("h", "dawn").alias("dawn"), D.day_part("h", "six").alias("six"),
        D.bucket("value", [10, 50], ["few", "some", "many"]).alias("bucket"), D.bucket("value", [0.5, 1.5], ["0", "1", "2+"]).alias("class"))


@query("SF33 SF3 SF39 SF44", """SELECT o_orderkey, [round_even((o_custkey + i * (o_custkey % 97) / 4.0)::DOUBLE, 0)::BIGINT for i in [0, 1, 2, 3, 4]]::VARCHAR AS frames, 'customer ' || o_custkey AS a, 'drug treats ' || o_orderpriority AS phrase, array_to_string(list_sort([o_orderstatus, 'A']), ';') AS set_text FROM orders""")
def position_functions(t):
    o = t("orders").withColumn("end", F.col("o_custkey") + F.col("o_custkey") % 97)
    said = X.options(F.concat(F.lit("A. customer "), F.col("o_custkey").cast("string"), F.lit(", B. x")))
    return o.select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform(D.even_positions("o_custkey", "end", 5), lambda x: x.cast("string")), ", "), F.lit("]")).alias("frames"), F.element_at(said, "A").alias("a"), X.template("drug treats %s", "o_orderpriority").alias("phrase"), X.set_text(F.array("o_orderstatus", F.lit("A"))).alias("set_text"))


@query("SF35 SF36 SET4")
def paragraph_chunks(t):
    """Chunks of documents without front matter; a fold that SQL lacks, held against a plain loop in tests."""
    d = t("documents").where("text IS NOT NULL").select("doc_id", X.chunk_paragraphs(X.front_matter_stripped("text")).alias("c"))
    return d.select("doc_id", F.size("c").alias("n_chunks"), F.array_max(F.transform("c", F.length)).alias("longest"), F.sha2(F.array_join("c", "\n"), 256).alias("sha256"))


@query("SF7", """SELECT p_partkey, CASE WHEN regexp_matches(lower(replace(p_name, ' ', '_')), '(^|_)(indoor|inside|store)(_|$)') THEN 'inside' ELSE 'outside' END AS place, coalesce(nullif(regexp_extract(lower(replace(p_name, ' ', '_')), '(rain|snow|fog|clear)', 1), ''), 'unknown') AS weather, try_cast(nullif(regexp_extract(lower(replace(p_name, ' ', '_')), '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS count FROM part""")
def slug_structs(t):
    return t("part").select("p_partkey", X.slug_attributes(F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("s")).select("p_partkey", "s.*")


@query("SF37")
def revision_facts(t):
    """Changed runs between an event's two renderings; a diff that SQL lacks, held against fixed cases in tests."""
    e = t("events").select("event_id", F.concat(F.lit("user "), "user_id", F.lit(" did a thing")).alias("old"), F.concat(F.lit("user "), "user_id", F.lit(" did "), "event_type").alias("new"))
    return e.select("event_id", F.explode(X.changed_facts("old", "new")).alias("f")).select("event_id", "f.old", "f.new", "f.cloze")
