"""Versioned reads: snapshots, publication, classification of reads, garbage, journals and protocols."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: an idempotent upsert of a log."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *[F.col(c) for c in rest if c != order])).alias("_x"))
    return last.select(*keys, "_x.*")


def publish(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, active_version, deleted, epoch after a log (doc_id, version, epoch, kind): the last entry of each document."""
    last = log.groupBy(key).agg(F.max("version").alias("active_version"), F.max("epoch").alias("epoch"), F.max_by("kind", "version").alias("_k"))
    return last.select(key, "active_version", (F.col("_k") == "delete").alias("deleted"), "epoch")


def snapshot(manifest: DataFrame) -> DataFrame:
    """The manifest with the global epoch beside each row: one row is joined to all."""
    return manifest.crossJoin(F.broadcast(manifest.agg(F.max("epoch").alias("global_epoch"))))


def active_rows(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the version that a document's manifest names, of documents that aren't deleted."""
    live = manifest.where(~F.col("deleted")).select("doc_id", F.col("active_version").alias("version"))
    return rows.join(live, ["doc_id", "version"], "left_semi")


def classify(dense: Column, sparse: Column, expected: Column, deleted: Column, either_layer: bool = False) -> dict[str, Column]:
    """stale, future, mixed, missing, error of a read's observed versions (arrays) in two layers.

    Of a deleted document any observation is stale. Missing: nothing is seen in both layers, or in either one.
    """
    seen = F.array_union(dense, sparse)
    any_ = F.size(seen) > 0
    stale = F.when(deleted, any_).otherwise(F.exists(seen, lambda v: v < expected))
    future = ~deleted & F.exists(seen, lambda v: v > expected)
    none = ((F.size(dense) == 0) | (F.size(sparse) == 0)) if either_layer else ~any_
    missing = ~deleted & none
    mixed = F.size(seen) > 1
    return {"stale": stale, "future": future, "mixed": mixed, "missing": missing, "error": stale | future | mixed | missing}


def answer_label(seen: Column, old: Column, new: Column) -> Column:
    o, n = F.array_contains(seen, old), F.array_contains(seen, new)
    return F.when(o & n, "AMBIGUOUS").when(n, "NEW_ONLY").when(o, "OLD_ONLY").otherwise("MISSING")


def readiness(rows: DataFrame, expected: DataFrame, layers: list[str]) -> DataFrame:
    """doc_id, version, ready: whether each layer holds as many distinct chunks as are expected (doc_id, version, n)."""
    got = rows.groupBy("doc_id", "version").pivot("layer", layers).agg(F.countDistinct("chunk_id")).na.fill(0)
    wide = expected.join(got, ["doc_id", "version"], "left").na.fill(0, layers)
    test = F.lit(True)
    for layer in layers:
        test = test & (F.col(layer) == F.col("n"))
    return wide.select("doc_id", "version", test.alias("ready"))


def garbage(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of other versions than the active one, and of deleted or unknown documents."""
    live = manifest.where(~F.col("deleted")).select("doc_id", F.col("active_version").alias("version"))
    return rows.join(live, ["doc_id", "version"], "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, extra: rows beyond the first of a key."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def invalidated(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """What stays in a cache once the changed documents are dropped from it."""
    return cache.join(changed.select("doc_id").distinct(), "doc_id", "left_anti")


#: The phases of each publication protocol, in order.
PROTOCOLS = {
    "naive": ("publish", "dense", "sparse", "delete", "cache"),
    "read_filter": ("publish", "dense", "sparse", "delete", "cache"),
    "staged": ("dense", "sparse", "publish"),
    "blue_green": ("rewrite_dense", "rewrite_sparse", "publish"),
    "atomic": ("all",),
    "four_artifact": ("dense", "sparse", "graph", "cache", "publish"),
}


def phase_log(spark: SparkSession, changes: DataFrame, protocols: list[str]) -> DataFrame:
    """protocol, doc_id, version, phase_no, phase: each change in the phases of each protocol, in order."""
    table = F.create_map(*[x for p in protocols for x in (F.lit(p), F.array(*[F.lit(s) for s in PROTOCOLS[p]]))])
    rows = changes.select(F.explode(F.array(*[F.lit(p) for p in protocols])).alias("protocol"), "doc_id", "version")
    return rows.select("protocol", "doc_id", "version", F.posexplode(table[F.col("protocol")]).alias("phase_no", "phase"))


def journal_state(events: DataFrame, needed: list[str]) -> DataFrame:
    """id, status, ready of recovery journals from (id, artifact): "published" once all needed artifacts are ready."""
    got = events.groupBy("id").agg(F.array_sort(F.collect_set("artifact")).alias("ready"))
    need = F.array(*[F.lit(x) for x in sorted(needed)])
    return got.select("id", F.when(F.size(F.array_except(need, F.col("ready"))) == 0, "published").otherwise("staged").alias("status"), "ready")


def reachable(starts: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All states that transitions reach from each start, with the least depth and the least of the paths of that depth.

    A state is a row; what tells machines apart (a document, a batch) is part of it, so machines of all documents are explored
    at once. step maps states, depth and path to (the same columns, action) of their successors. Each level is one plan over
    the states found in the level before, stored in the shared folder; a state seen before goes by an anti-join, and the
    levels end when one adds nothing, as they do for a finite machine. No state passes the driver. Equal starts are one.
    """
    cols = starts.columns
    front = seen = stored(starts.distinct().withColumn("depth", F.lit(0)).withColumn("path", F.array().cast("array<string>")), "states")
    depth = 0
    while not front.isEmpty():
        depth += 1
        after = step(front).withColumn("path", F.concat("path", F.array("action")))
        new = after.groupBy(*cols).agg(F.min("path").alias("path"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
        fresh = new.alias("a").join(seen.alias("b"), reduce(lambda x, y: x & y, same), "left_anti")
        front = stored(fresh.select(*cols, F.lit(depth).alias("depth"), "path"), "states")
        seen = seen.unionByName(front)
    return seen


def protocol_summary(reads: DataFrame, by: str = "protocol") -> DataFrame:
    """Of reads (protocol, error, update_window, latency, writes, changes): rates in all and in update windows, percentiles,
    write amplification and a Wilson interval of the error rate."""
    from .stats import wilson

    t = reads.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if("error").alias("errors"), F.count_if(F.col("update_window")).alias("window_n"), F.count_if(F.col("error") & F.col("update_window")).alias("window_errors"),
        F.round(F.percentile("latency", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("latency", F.lit(0.95)), 6).alias("p95"), F.round(F.sum("writes") / F.sum("changes"), 6).alias("write_amplification"))
    lo, hi = wilson(F.col("errors"), F.col("n"))
    return t.select(by, "n", "errors", F.round(F.try_divide("window_errors", "window_n"), 6).alias("window_rate"), "p50", "p95", "write_amplification", lo.alias("lo"), hi.alias("hi"))


def exposure(daily: DataFrame, seconds: float) -> DataFrame:
    """page, day, edits, views, unsafe: edits x views / 86400 x exposed seconds; and page totals with a null day."""
    rows = daily.withColumn("unsafe", F.col("edits") * F.col("views") / 86400.0 * F.lit(float(seconds)))
    sets = rows.groupingSets([[F.col("page"), F.col("day")], [F.col("page")]], F.col("page"), F.col("day"))
    return sets.agg(F.sum("edits").alias("edits"), F.sum("views").alias("views"), F.round(F.sum("unsafe"), 6).alias("unsafe"))


def break_even(updates: DataFrame, rates: list[float], gate: float) -> DataFrame:
    """domain, protocol, qps, updates_per_day, error_seconds, exposed, break_even_qps, errors_per_day, applicable of updates
    (domain, ts, protocol, seconds, error): one row for each stated rate of queries.

    An update leaves mean seconds x error rate of wrong answers behind; with so many updates a day, the break-even rate gives
    one wrong answer a day (null where there are none), and a protocol is applicable where that rate is at most the gate.
    A domain's rate is its updates over the days between the first and the last; without such a span it has no rows.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    c = updates.groupBy("domain", "protocol").agg(F.count("*").alias("_n"), F.min(micros).alias("_a"), F.max(micros).alias("_z"), F.avg("seconds").alias("_s"), F.avg(F.col("error").cast("int")).alias("_e"))
    d = c.groupBy("domain").agg(F.sum("_n").alias("_n"), ((F.max("_z") - F.min("_a")) / 86400e6).alias("_days")).where("_days > 0")
    r = c.select("domain", "protocol", (F.col("_s") * F.col("_e")).alias("_u")).join(d.select("domain", (F.col("_n") / F.col("_days")).alias("_d")), "domain")
    even = F.when(F.col("_u") > 0, 1 / (F.col("_d") * F.col("_u")))
    out = r.select("*", F.explode(F.array(*[F.lit(float(x)) for x in rates])).alias("qps"))
    return out.select(
        "domain", "protocol", "qps", F.round("_d", 6).alias("updates_per_day"), F.round("_u", 9).alias("error_seconds"), F.round(F.col("_d") * F.col("_u") / 86400, 12).alias("exposed"),
        F.round(even, 6).alias("break_even_qps"), F.round(F.col("_d") * F.col("_u") * F.col("qps"), 6).alias("errors_per_day"), F.coalesce(even <= gate, F.lit(False)).alias("applicable"))
