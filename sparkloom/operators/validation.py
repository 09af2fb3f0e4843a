"""Blocked cross validation of retrieval: sites are folds, what is chosen is chosen on the other folds, gates are stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ideal
from .retrieval import exact_scores, rank_by
from .windows import folds as assigned


def fold_association(items: DataFrame, family: str, value: str) -> DataFrame:
    """fold, family, v: the bias-corrected V of `value` and of belonging to the family, over all folds but the one named.

    items: fold and the two columns. Only counts of (fold, family, value) are met, never items. v is null where a side has
    fewer than two levels.
    """
    c = items.where(F.col(value).isNotNull()).groupBy("fold", F.col(family).alias("g"), F.col(value).alias("x")).agg(F.count("*").alias("n"))
    out = c.select("fold").distinct().withColumnRenamed("fold", "out")
    rest = c.join(out, F.col("fold") != F.col("out"))  # counts and as many folds as are asked for
    hits = rest.where("g IS NOT NULL").groupBy("out", "g", "x").agg(F.sum("n").alias("n1"))
    levels = rest.groupBy("out", "x").agg(F.sum("n").alias("nx"))
    size = levels.groupBy("out").agg(F.sum("nx").alias("n"), F.count("*").alias("rows"))
    total = hits.groupBy("out", "g").agg(F.sum("n1").alias("g1"))
    # sum of n_ij^2 / (n_i n_j) over cells: values without a hit add n_i / (n - g1) each
    cell = hits.join(levels, ["out", "x"]).join(total, ["out", "g"]).join(size, "out")
    per = cell.groupBy("out", "g").agg(
        F.sum(F.col("n1") ** 2 / (F.col("nx") * F.col("g1"))).alias("a"), F.sum(F.try_divide((F.col("nx") - F.col("n1")) ** 2, F.col("nx") * (F.col("n") - F.col("g1")))).alias("b"),
        F.sum("nx").alias("seen"), F.first("n").alias("n"), F.first("g1").alias("g1"), F.first("rows").alias("rows"))
    n, r = F.col("n"), F.col("rows")
    phi2 = F.col("a") + F.col("b") + (n - F.col("seen")) / (n - F.col("g1")) - 1
    v = F.sqrt(F.greatest(F.lit(0.0), phi2 - (r - 1) / (n - 1)) / F.least(1 - 1 / (n - 1), r - (r - 1) ** 2 / (n - 1) - 1))
    return per.select(F.col("out").alias("fold"), F.col("g").alias(family), F.round(F.when((r > 1) & (F.col("g1") < n) & (n > 2), v), 6).alias("v"))


def blocked(items: DataFrame, queries: DataFrame, site: str, family: str, predicate: str, folds: int = 5, seed: str = "20260723", k: int = 10, least_positives: int = 5, least_candidates: int = 10) -> DataFrame:
    """fold, query_id, family, positives, candidates, status, plain, filtered, chosen, score: each query in each held-out fold.

    items: item_id, vector, site, family (what is relevant together), predicate. queries: query_id, vector, family, predicate;
    a query isn't its own result. Sites are dealt to folds in the order of a hash. A query counts in a fold that holds
    least_positives relevant items and least_candidates items of its predicate's value, else status names what it lacks and its
    scores are null. plain and filtered are nDCG at k of the held-out fold's items, and of those with the predicate's value; the
    ideal has all folds' relevant items. chosen is the way with the better mean over the family's queries that count in the other
    folds (plain on a tie, or without any), score is what it gives here. Items without a site are in no fold.
    """
    where = assigned(items.select(F.col(site)).where(F.col(site).isNotNull()), site, folds, seed)
    own = items.join(where, site)
    n_rel = items.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("_all"))
    positives = own.groupBy("fold", family).agg(F.count("*").alias("positives"))
    candidates = own.groupBy("fold", predicate).agg(F.count("*").alias("candidates"))
    asked = queries.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(folds)])))
    state = asked.select("query_id", "fold", family, predicate).join(positives, ["fold", family], "left").join(candidates, ["fold", predicate], "left").na.fill(0, ["positives", "candidates"])
    state = state.withColumn("status", F.when(F.col("positives") < least_positives, "insufficient_positives").when(F.col("candidates") < least_candidates, "insufficient_candidates").otherwise("ok"))

    both = F.col("query_id") * folds + F.col("fold")  # a query in a fold, as one id
    met = asked.join(state.where("status = 'ok'").select("query_id", "fold"), ["query_id", "fold"], "left_semi")
    relevant = items.select("item_id", F.col(family).alias("_f"))

    def ndcg(on: list[str], name: str) -> DataFrame:
        s = exact_scores(own, met.select(both.alias("query_id"), "vector", *on), k + 1, exclude_self=False, on=on)
        s = s.select(F.floor(F.col("query_id") / folds).alias("query_id"), F.pmod("query_id", F.lit(folds)).cast("int").alias("fold"), "item_id", "score").where("query_id <> item_id")
        top = rank_by(s, ["query_id", "fold"], F.desc("score"), F.asc("item_id"), k=k)
        hit = top.join(relevant, "item_id").join(queries.select("query_id", F.col(family).alias("_g")), "query_id").where("_f = _g")
        return hit.groupBy("query_id", "fold").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias(name))

    out = state.join(n_rel, family, "left").join(ndcg(["fold"], "_p"), ["query_id", "fold"], "left").join(ndcg(["fold", predicate], "_q"), ["query_id", "fold"], "left")
    gain = lambda c: F.when(F.col("status") == "ok", F.round(F.coalesce(F.col(c), F.lit(0.0)) / ideal(F.col("_all"), k), 9))
    out = out.select("fold", "query_id", family, "positives", "candidates", "status", gain("_p").alias("plain"), gain("_q").alias("filtered"))
    per = out.where("status = 'ok'").groupBy(family, "fold").agg(F.sum(F.col("filtered") - F.col("plain")).alias("_d"))
    every = per.groupBy(family).agg(F.sum("_d").alias("_t"))
    other = F.coalesce(F.col("_t"), F.lit(0.0)) - F.coalesce(F.col("_d"), F.lit(0.0))
    out = out.join(every, family, "left").join(per, [family, "fold"], "left").withColumn("chosen", F.when(F.round(other, 6) > 0, "filtered").otherwise("plain"))
    return out.select("fold", "query_id", family, "positives", "candidates", "status", "plain", "filtered", "chosen", F.when(F.col("chosen") == "filtered", F.col("filtered")).otherwise(F.col("plain")).alias("score"))


def fold_summary(per_query: DataFrame, family: str) -> DataFrame:
    """fold, family, total, eligible, chosen, delta (mean of filtered less plain), score (mean of what was chosen elsewhere)."""
    return per_query.groupBy("fold", family, "chosen").agg(F.count("*").alias("total"), F.count("plain").alias("eligible"), F.round(F.avg(F.col("filtered") - F.col("plain")), 6).alias("delta"), F.round(F.avg("score"), 6).alias("score"))


def bands(v: Column) -> Column:
    """Bounds of low, mid and high association."""
    return F.when(v < 0.15, "low").when(v < 0.30, "mid").when(v.isNotNull(), "high")
