"""Publication of four artifacts of each user's first and last event: what reads see at each step of a protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import query
from ..operators import publication as P
from ..operators import versioning as V
from ..sources.shared import shared_folder


def worlds(t) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The four artifacts of version 1 (a user's first event) and 2 (the last event)."""
    order, what = F.struct("ts", "event_id"), F.struct("event_type", "value")
    u = t("events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("doc_id")).agg(F.min_by(what, order).alias("old"), F.max_by(what, order).alias("new"))

    def made(side: str, version: int) -> dict[str, DataFrame]:
        kind, value = F.col(f"{side}.event_type"), F.col(f"{side}.value")
        payloads = {"dense": F.coalesce(F.floor(value * 100).cast("string"), F.lit("none")), "sparse": kind, "graph": F.concat(F.lit("source:"), F.col("doc_id").cast("string"), F.lit("->answer:"), kind), "cache": F.to_json(F.struct(kind.alias("answer")))}
        return {a: u.select("doc_id", F.lit(version).alias("version"), p.alias("payload")) for a, p in payloads.items()}

    return made("old", 1), made("new", 2)


_LAST = """u AS (SELECT user_id AS doc_id, arg_min(event_type, (ts, event_id)) AS old, arg_max(event_type, (ts, event_id)) AS new, arg_min(struct_pack(v := floor(value * 100)::BIGINT), (ts, event_id)).v AS cents FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"""


def _target(t) -> P.Publication:
    spark = t("region").sparkSession
    return P.Publication(spark, shared_folder(spark, "publication"))


@query("VER14 SRC18", f"""WITH {_LAST}, p AS (SELECT doc_id, unnest(['dense', 'sparse', 'graph', 'cache']) AS artifact, old, cents FROM u)
SELECT doc_id, artifact, 1::BIGINT AS version, CASE artifact WHEN 'dense' THEN coalesce(cents::VARCHAR, 'none') WHEN 'sparse' THEN old WHEN 'graph' THEN 'source:' || doc_id || '->answer:' || old ELSE '{{"answer":"' || old || '"}}' END AS payload FROM p""")
def half_published(t):
    """Reads while a second version is half there: three artifacts are staged, and a manifest is written whose commit is missing."""
    old, new = worlds(t)
    target = _target(t)
    for a in target.artifacts:
        target.stage(1, a, old[a])
    target.publish(1)
    for a in ("dense", "sparse", "graph"):
        target.stage(2, a, new[a])
    target.write_manifest(2, new["dense"])
    snapshot, out = target.manifest(), None
    for a in target.artifacts:
        part = target.read(a, snapshot).select("doc_id", F.lit(a).alias("artifact"), "version", "payload")
        out = part if out is None else out.unionByName(part)
    return out


@query("VER14 VER10", """WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events),
s AS (SELECT * FROM (VALUES ('eager', 0, 'initial'), ('eager', 1, 'manifest_published'), ('eager', 2, 'dense_staged'), ('eager', 3, 'sparse_staged'), ('eager', 4, 'graph_staged'), ('eager', 5, 'cache_staged'), ('read_filter', 0, 'initial'), ('read_filter', 1, 'manifest_published'), ('read_filter', 2, 'dense_staged'), ('read_filter', 3, 'sparse_staged'), ('read_filter', 4, 'graph_staged'), ('read_filter', 5, 'cache_staged'), ('staged', 0, 'initial'), ('staged', 2, 'dense_staged'), ('staged', 3, 'sparse_staged'), ('staged', 4, 'graph_staged'), ('staged', 5, 'cache_staged'), ('staged', 6, 'manifest_published')) v(protocol, step, checkpoint)),
w AS (SELECT protocol, checkpoint, [CASE protocol WHEN 'eager' THEN step >= 1 WHEN 'read_filter' THEN step BETWEEN 1 AND i ELSE false END FOR i IN [1, 2, 3, 4]] AS bad FROM s),
c AS (SELECT protocol, checkpoint, n AS observations, CASE WHEN list_contains(bad, true) THEN n ELSE 0 END AS errors, CASE WHEN bad[1] THEN n ELSE 0 END AS dense_errors, CASE WHEN bad[2] THEN n ELSE 0 END AS sparse_errors, CASE WHEN bad[3] THEN n ELSE 0 END AS graph_errors, CASE WHEN bad[4] THEN n ELSE 0 END AS cache_errors FROM w, n),
z AS (SELECT *, errors * 1.0::DOUBLE / observations AS p, 1.959963984540054::DOUBLE AS z, observations::DOUBLE AS m FROM c)
SELECT protocol, checkpoint, observations, errors, dense_errors, sparse_errors, graph_errors, cache_errors, round(p, 9) AS rate, round((p + z * z / (2 * m)) / (1 + z * z / m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m), 9) AS lo, round((p + z * z / (2 * m)) / (1 + z * z / m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m), 9) AS hi FROM z""")
def publication_errors(t):
    """Errors of reads after each step of three protocols, from what is stored at that moment."""
    old, new = worlds(t)
    kept = None
    eager, staged = P.rehearse(_target(t), old, new, True), P.rehearse(_target(t), old, new, False)
    for protocol, name, reads in [*(("eager", n, plain) for n, plain, _ in eager), *(("read_filter", n, few) for n, _, few in eager), *(("staged", n, few) for n, _, few in staged)]:
        part = reads.select(F.lit(protocol).alias("protocol"), F.lit(name).alias("checkpoint"), "active", *P.ARTIFACTS)
        kept = part if kept is None else kept.unionByName(part)
    return P.error_rates(kept, P.ARTIFACTS, ["protocol", "checkpoint"])


@query("VER19", """WITH e AS (SELECT event_type AS domain, user_id, ts, event_id, value FROM events),
d AS (SELECT domain, count(*) AS updates, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS days FROM e GROUP BY domain),
p AS (SELECT domain, CASE WHEN event_id % 3 = 0 THEN 'atomic' WHEN event_id % 3 = 1 THEN 'naive' ELSE 'staged' END AS protocol, avg(value) / 1000 AS s, avg(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS err FROM e GROUP BY ALL),
r AS (SELECT domain, protocol, updates / days AS per_day, s * err AS unsafe FROM p JOIN d USING (domain) WHERE days > 0)
SELECT domain, protocol, qps::DOUBLE AS qps, round(per_day, 6) AS updates_per_day, round(unsafe, 9) AS error_seconds, round(per_day * unsafe / 86400, 12) AS exposed, CASE WHEN unsafe > 0 THEN round(1 / (per_day * unsafe), 6) END AS break_even_qps, round(per_day * unsafe * qps, 6) AS errors_per_day, coalesce(unsafe > 0 AND 1 / (per_day * unsafe) <= 20, false) AS applicable FROM r, (VALUES (0.1), (1), (5), (20)) v(qps)""")
def break_even_rates(t):
    """Rates of queries at which each protocol gives one wrong answer a day, and errors a day at stated rates."""
    e = t("events").select(F.col("event_type").alias("domain"), "ts", F.element_at(F.array(F.lit("atomic"), F.lit("naive"), F.lit("staged")), (F.col("event_id") % 3 + 1).cast("int")).alias("protocol"), (F.col("value") / 1000).alias("seconds"), ((F.col("event_id") % 3 != 0) & (F.col("event_id") % 7 == 0)).alias("error"))
    return V.break_even(e, [0.1, 1.0, 5.0, 20.0], 20.0)
