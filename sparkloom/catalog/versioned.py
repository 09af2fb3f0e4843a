"""Versioned reads over events: a user is a document, its events are versions in order of time, their types are kinds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import query
from ..operators import versioning as V


def log(t):
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_type") == "purchase", "delete").otherwise("write")
    return t("events").select(F.col("user_id").alias("doc_id"), no.cast("bigint").alias("version"), (F.col("event_id") % 5).alias("epoch"), kind.alias("kind"), "event_id", "value")


LOG = """log AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_id % 5 AS epoch, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'write' END AS kind, event_id, value FROM events),
man AS (SELECT doc_id, max(version) AS active_version, arg_max(kind, version) = 'delete' AS deleted, max(epoch) AS epoch FROM log GROUP BY doc_id)"""


@query("VER1 VER2", f"WITH {LOG} SELECT doc_id, active_version, deleted, epoch, (SELECT max(epoch) FROM man) AS global_epoch FROM man")
def snapshot(t):
    return V.snapshot(V.publish(log(t)))


@query("VER3", f"WITH {LOG}, k AS (SELECT doc_id, epoch, version, kind, row_number() OVER (PARTITION BY doc_id, epoch ORDER BY version DESC) AS r FROM log) SELECT doc_id, epoch, version, kind FROM k WHERE r = 1")
def last_writes(t):
    rows = log(t).select("doc_id", "epoch", "version", "kind")
    return V.upsert(rows.unionByName(rows), ["doc_id", "epoch"], "version")


def layers(t):
    """Rows of two layers: dense has all versions, sparse lacks every fourth event."""
    r = log(t)
    chunk = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("chunk_id")
    dense = r.select("doc_id", "version", chunk, F.lit("dense").alias("layer"), "value")
    return dense.unionByName(r.where("event_id % 4 <> 0").select("doc_id", "version", chunk, F.lit("sparse").alias("layer"), "value"))


_LAYERS = LOG + """, rows_ AS (SELECT doc_id, version, doc_id || '-' || event_id AS chunk_id, 'dense' AS layer, value FROM log UNION ALL SELECT doc_id, version, doc_id || '-' || event_id, 'sparse', value FROM log WHERE event_id % 4 <> 0)"""


@query("VER4 VER14", f"WITH {_LAYERS} SELECT r.doc_id, r.version, r.layer, r.chunk_id FROM rows_ r JOIN man m ON m.doc_id = r.doc_id AND m.active_version = r.version AND NOT m.deleted")
def active_rows(t):
    return V.active_rows(layers(t), V.publish(log(t))).select("doc_id", "version", "layer", "chunk_id")


_READS = LOG + """, reads AS (SELECT l.doc_id, l.version, m.active_version AS expected, m.deleted, CASE WHEN l.event_id % 7 = 0 THEN []::BIGINT[] ELSE [l.version] END AS dense, CASE WHEN l.event_id % 3 = 0 THEN [greatest(l.version - 1, 1)] WHEN l.event_id % 5 = 0 THEN []::BIGINT[] ELSE [l.version] END AS sparse, l.event_id, l.value FROM log l JOIN man m USING (doc_id)),
c AS (SELECT *, list_distinct(dense || sparse) AS seen FROM reads)"""


def reads(t):
    v, e = F.col("version"), F.col("event_id")
    none = F.array().cast("array<bigint>")
    r = log(t).join(V.publish(log(t)).select("doc_id", F.col("active_version").alias("expected"), "deleted"), "doc_id")
    r = r.withColumn("dense", F.when(e % 7 == 0, none).otherwise(F.array(v)))
    return r.withColumn("sparse", F.when(e % 3 == 0, F.array(F.greatest(v - 1, F.lit(1)).cast("bigint"))).when(e % 5 == 0, none).otherwise(F.array(v)))


def _flags(either: str) -> str:
    return f"""CASE WHEN deleted THEN len(seen) > 0 ELSE len(list_filter(seen, lambda v: v < expected)) > 0 END AS stale, NOT deleted AND len(list_filter(seen, lambda v: v > expected)) > 0 AS future, len(seen) > 1 AS mixed, NOT deleted AND {either} AS missing"""


@query("VER5 SET5", f"WITH {_READS}, f AS (SELECT event_id, {_flags('len(seen) = 0')} FROM c) SELECT *, stale OR future OR mixed OR missing AS error FROM f")
def classify_reads(t):
    r = reads(t)
    return r.select("event_id", *[c.alias(k) for k, c in V.classify(F.col("dense"), F.col("sparse"), F.col("expected"), F.col("deleted")).items()])


@query("VER6", f"WITH {_READS}, f AS (SELECT event_id, {_flags('(len(dense) = 0 OR len(sparse) = 0)')} FROM c) SELECT event_id, missing, stale OR future OR mixed OR missing AS error FROM f")
def classify_either(t):
    c = V.classify(F.col("dense"), F.col("sparse"), F.col("expected"), F.col("deleted"), either_layer=True)
    return reads(t).select("event_id", c["missing"].alias("missing"), c["error"].alias("error"))


@query("VER7 SF44", f"WITH {_READS} SELECT event_id, CASE WHEN list_contains(seen, version - 1) AND list_contains(seen, version) THEN 'AMBIGUOUS' WHEN list_contains(seen, version) THEN 'NEW_ONLY' WHEN list_contains(seen, version - 1) THEN 'OLD_ONLY' ELSE 'MISSING' END AS label, array_to_string(list_sort(seen), ';') AS seen FROM c")
def answer_labels(t):
    seen = F.array_union("dense", "sparse")
    return reads(t).select("event_id", V.answer_label(seen, F.col("version") - 1, F.col("version")).alias("label"), F.array_join(F.array_sort(F.transform(seen, lambda x: x)), ";").alias("seen"))


@query("VER8", f"WITH {_LAYERS} SELECT doc_id, version, count(DISTINCT chunk_id) FILTER (layer = 'dense') = 1 AND count(DISTINCT chunk_id) FILTER (layer = 'sparse') = 1 AS ready FROM rows_ GROUP BY ALL")
def layer_readiness(t):
    want = log(t).select("doc_id", "version", F.lit(1).alias("n"))
    return V.readiness(layers(t), want, ["dense", "sparse"])


@query("VER9 VER10 VER11 VER12", """WITH c AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events), p AS (SELECT * FROM (VALUES ('atomic', ['all']), ('blue_green', ['rewrite_dense', 'rewrite_sparse', 'publish']), ('naive', ['publish', 'dense', 'sparse', 'delete', 'cache']), ('staged', ['dense', 'sparse', 'publish'])) v(protocol, phases))
SELECT protocol, doc_id, version, (i - 1)::INT AS phase_no, phases[i] AS phase FROM (SELECT protocol, phases, doc_id, version, unnest(range(1, len(phases) + 1)) AS i FROM p, (SELECT * FROM c WHERE version = 1))""")
def protocol_phases(t):
    changes = log(t).where("version = 1")
    return V.phase_log(changes.sparkSession, changes, ["naive", "staged", "blue_green", "atomic"])


@query("VER13", f"WITH {_LAYERS} SELECT r.doc_id, r.version, r.layer FROM rows_ r LEFT JOIN man m ON m.doc_id = r.doc_id AND m.active_version = r.version AND NOT m.deleted WHERE m.doc_id IS NULL")
def garbage_rows(t):
    return V.garbage(layers(t), V.publish(log(t))).select("doc_id", "version", "layer")


@query("VER13", f"WITH {_LAYERS} SELECT doc_id, layer, count(*) - 1 AS extra FROM rows_ GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(t):
    return V.duplicates(layers(t), ["doc_id", "layer"])


@query("VER15", """SELECT user_id AS id, CASE WHEN count(DISTINCT event_type) FILTER (event_type IN ('view', 'purchase')) = 2 THEN 'published' ELSE 'staged' END AS status, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS ready FROM events GROUP BY user_id""")
def journals(t):
    e = t("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("artifact"))
    return V.journal_state(e, ["view", "purchase"]).select("id", "status", F.array_join("ready", ",").alias("ready"))


@query("VER16", """WITH RECURSIVE u AS (SELECT user_id AS doc_id, event_id % 5 AS epoch, bool_or(event_type = 'view') AS w, bool_or(event_type = 'click') AS c, bool_or(event_type = 'signup') AS g FROM events GROUP BY ALL),
s AS (SELECT doc_id, epoch, 0 AS d, 0 AS p, 0 AS k, '' AS path FROM u UNION
SELECT s.doc_id, s.epoch, CASE WHEN a.x = 'dense' THEN 1 ELSE d END, CASE WHEN a.x = 'publish' THEN 1 ELSE p END, CASE WHEN a.x = 'cache' THEN 1 ELSE k END, path || a.x || ','
FROM s JOIN u ON u.doc_id = s.doc_id AND u.epoch = s.epoch, (VALUES ('dense'), ('publish'), ('cache')) a(x) WHERE (a.x = 'dense' AND w AND d = 0) OR (a.x = 'publish' AND c AND p = 0) OR (a.x = 'cache' AND g AND k = 0 AND d = 1))
SELECT doc_id, epoch, d AS dense, p AS published, k AS cached, d + p + k AS depth, rtrim(min(path), ',') AS path, p = 1 AND d = 0 AS violates FROM s GROUP BY ALL""")
def model_check(t):
    """All states that each document's batch can get into by the actions in its log (view: write the dense layer, click:
    publish, signup: fill the cache, which takes a dense layer), breadth first, with the least path to each; a state that is
    published before it is dense violates the invariant."""
    kinds = {"view": "can_write", "click": "can_publish", "signup": "can_cache"}
    own = t("events").groupBy(F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).alias("epoch"))
    starts = own.agg(*[F.bool_or(F.col("event_type") == x).alias(c) for x, c in kinds.items()], *[F.min(F.lit(0)).alias(c) for c in ("dense", "published", "cached")])

    def step(front):
        rules = [("dense", "dense", F.expr("can_write AND dense = 0")), ("publish", "published", F.expr("can_publish AND published = 0")), ("cache", "cached", F.expr("can_cache AND cached = 0 AND dense = 1"))]
        moves = F.array(*[F.when(rule, F.lit(name)) for name, _, rule in rules])
        after = front.withColumn("action", F.explode(F.array_compact(moves)))
        return after.withColumns({c: F.when(F.col("action") == name, 1).otherwise(F.col(c)) for name, c, _ in rules})

    states = V.reachable(starts, step)
    return states.select("doc_id", "epoch", "dense", "published", "cached", "depth", F.array_join("path", ",").alias("path"), ((F.col("published") == 1) & (F.col("dense") == 0)).alias("violates"))


@query("VER17", f"""WITH {_READS}, f AS (SELECT event_id, value, {_flags('len(seen) = 0')} FROM c), r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'staged' ELSE 'naive' END AS protocol, stale OR future OR mixed OR missing AS error, event_id % 10 < 3 AS win, value FROM f),
g AS (SELECT protocol, count(*) AS n, count(*) FILTER (error) AS errors, round(count(*) FILTER (error AND win) * 1.0 / count(*) FILTER (win), 6) AS window_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, 2.0::DOUBLE AS write_amplification FROM r GROUP BY protocol), z AS (SELECT *, errors * 1.0::DOUBLE / n AS p, 1.959963984540054::DOUBLE AS z FROM g)
SELECT protocol, n, errors, window_rate, p50, p95, write_amplification, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n), 9) AS lo, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n), 9) AS hi FROM z""")
def protocol_summary(t):
    c = V.classify(F.col("dense"), F.col("sparse"), F.col("expected"), F.col("deleted"))
    r = reads(t).select(F.when(F.col("event_id") % 2 == 0, "staged").otherwise("naive").alias("protocol"), c["error"].alias("error"), (F.col("event_id") % 10 < 3).alias("update_window"), F.col("value").alias("latency"), F.lit(2).alias("writes"), F.lit(1).alias("changes"))
    return V.protocol_summary(r)


@query("VER18 VER19 SRC19", """WITH d AS (SELECT event_type AS page, strftime(ts, '%Y-%m-%d') AS day, count(*) AS edits, sum(user_id) AS views FROM events GROUP BY ALL), u AS (SELECT *, edits * views / 86400.0::DOUBLE * 30.0::DOUBLE AS unsafe FROM d)
SELECT page, day, sum(edits)::BIGINT AS edits, sum(views)::BIGINT AS views, round(sum(unsafe), 6) AS unsafe FROM u GROUP BY GROUPING SETS ((page, day), (page))""")
def daily_exposure(t):
    d = t("events").groupBy(F.col("event_type").alias("page"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("edits"), F.sum("user_id").alias("views"))
    return V.exposure(d, 30.0)


@query("VER20", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cache_after_changes(t):
    return V.invalidated(t("documents").select("doc_id", "source"), t("labels").where("toxic = 1"))


@query("VER5", """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_counts(t):
    from ..streaming.versions import windowed_counts

    return windowed_counts(t("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("VER5", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(t):
    from ..streaming.versions import sessions

    return sessions(t("events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
