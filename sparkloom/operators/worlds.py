"""Two worlds of edges, the original and a counterfactual one: does the second still tell the first one's answer?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGINAL, OTHER = "original", "counterfactual"


def plain(c: Column | str) -> Column:
    """Lower-cased letters a-z and digits; runs of anything else are one blank, none at the ends. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def holds(text: Column, part: Column) -> Column:
    """Whether a plain text holds a plain part that isn't empty; null counts as no."""
    return F.coalesce((F.length(part) > 0) & F.contains(text, part), F.lit(False))


def holders(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """answer, first, last: the least and the greatest fact_id of the texts (fact_id, text) that hold an answer (answer).

    Texts are cut into all strings that are as long as some answer; these are summed up to two ids each where they lie, then
    met by equality. So no pairs of facts arise, however many texts hold a frequent answer. The set of lengths is one row,
    no longer than the longest answer.
    """
    known = answers.where(F.length("answer") > 0).select("answer").distinct()
    lengths = known.agg(F.collect_set(F.length("answer")).alias("lengths"))
    cut = texts.crossJoin(F.broadcast(lengths)).select("fact_id", "text", F.explode("lengths").alias("m")).where(F.length("text") >= F.col("m"))
    starts = cut.select("fact_id", "text", "m", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("m") + 1)).alias("i"))
    windows = starts.select("fact_id", F.col("text").substr(F.col("i"), F.col("m")).alias("answer"))
    return windows.groupBy("answer").agg(F.min("fact_id").alias("first"), F.max("fact_id").alias("last")).join(known, "answer")


def fact_checks(facts: DataFrame, edges: DataFrame, renderings: DataFrame, aliases: DataFrame, tolerance: float = 0.1, size: int = 2) -> DataFrame:
    """fact_id and one flag for each check; l and p flags tell of a leak, s flags of worlds that match.

    facts: fact_id, head, mid, relation, tail, other (the counterfactual tail), question. edges: world, fact_id, subject,
    relation, object. renderings: world, fact_id, form, text. aliases: name, alias.
    l1_surface, l2_alias: the fact's counterfactual texts hold its answer, or an alias of it. l3_inverse: they hold the edge
    from the other tail back to mid. l4_elsewhere: another fact's counterfactual texts hold the answer. l5_prompt: the question does.
    p1_path: two counterfactual edges of any facts lead from head to the answer. p2_renamed: a counterfactual edge leads from mid by the
    same relation to an alias of the answer.
    s1_size: both worlds have `size` edges of the fact. s2_tail: they differ in one edge, and there in its object alone. s3_tokens: the
    counterfactual forms' words differ by at most the tolerance of the mean of least and most. s4_degree: each
    subject of the fact's edges has as many edges in both worlds.
    Answers, entities and aliases are compared as plain text. fact_id is unique; a fact without texts or edges leaks nothing and
    fails the s checks that need them.
    """
    f = facts.select("fact_id", plain("head").alias("head"), plain("mid").alias("mid"), plain("relation").alias("relation"), plain("tail").alias("answer"), plain("other").alias("other"), plain("question").alias("question"))
    blob = renderings.where(F.col("world") == OTHER).groupBy("fact_id").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("form", plain("text").alias("t")))), lambda x: x["t"])).alias("text"),
        F.max(_words("text")).alias("_most"), F.min(_words("text")).alias("_least"))
    wide = f.join(blob, "fact_id", "left")
    names = aliases.select(plain("name").alias("answer"), plain("alias").alias("alias")).where("answer <> alias").distinct()
    named = wide.select("fact_id", "answer", "mid", "relation", "text").join(names, "answer")
    by_alias = named.groupBy("fact_id").agg(F.max(holds(F.col("text"), F.col("alias"))).alias("l2_alias"))

    e = edges.select("world", "fact_id", plain("subject").alias("s"), plain("relation").alias("r"), plain("object").alias("o"))
    there = e.where(F.col("world") == OTHER).select("s", "r", "o").distinct()
    # head -> x and x -> answer: both ends are given, so a hub's edges meet only what leads to an answer
    first = f.select("fact_id", "head", "answer").join(there.select(F.col("s").alias("head"), F.col("o").alias("x")).distinct(), "head")
    path = first.join(there.select(F.col("s").alias("x"), F.col("o").alias("answer")).distinct(), ["x", "answer"], "left_semi").select("fact_id").distinct().withColumn("p1_path", F.lit(True))
    renamed = named.select("fact_id", F.col("mid").alias("s"), F.col("relation").alias("r"), F.col("alias").alias("o")).join(there, ["s", "r", "o"], "left_semi").select("fact_id").distinct().withColumn("p2_renamed", F.lit(True))

    side = lambda w: F.array_sort(F.collect_set(F.when(F.col("world") == w, F.struct("s", "r", "o"))))
    sets = e.groupBy("fact_id").agg(side(ORIGINAL).alias("a"), side(OTHER).alias("b"))
    differ = F.filter(F.arrays_zip("a", "b"), lambda z: ~z["a"].eqNullSafe(z["b"]))
    only = F.element_at(differ, 1)
    tail = F.when(F.size(differ) == 1, (only["a"]["s"] == only["b"]["s"]) & (only["a"]["r"] == only["b"]["r"]))
    sets = sets.select("fact_id", ((F.size("a") == size) & (F.size("b") == size)).alias("s1_size"), F.coalesce(tail, F.lit(False)).alias("s2_tail"))
    degree = e.distinct().groupBy("s").agg(F.count_if(F.col("world") == ORIGINAL).alias("n"), F.count_if(F.col("world") == OTHER).alias("m"))
    uneven = e.join(degree.where("n <> m"), "s", "left_semi").select("fact_id").distinct().withColumn("_uneven", F.lit(True))

    out = wide.join(by_alias, "fact_id", "left").join(holders(blob, f).withColumnRenamed("first", "_first").withColumnRenamed("last", "_last"), "answer", "left")
    for part in (path, renamed, sets, uneven):
        out = out.join(part, "fact_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    elsewhere = (F.col("_first") != F.col("fact_id")) | (F.col("_last") != F.col("fact_id"))
    back = F.concat_ws(" ", "other", "relation", "mid")
    spread = 2 * (F.col("_most") - F.col("_least")) <= tolerance * (F.col("_most") + F.col("_least"))
    return out.select(
        "fact_id", holds(F.col("text"), F.col("answer")).alias("l1_surface"), no("l2_alias").alias("l2_alias"), holds(F.col("text"), back).alias("l3_inverse"),
        F.coalesce(elsewhere, F.lit(False)).alias("l4_elsewhere"), holds(F.col("question"), F.col("answer")).alias("l5_prompt"), no("p1_path").alias("p1_path"), no("p2_renamed").alias("p2_renamed"),
        no("s1_size").alias("s1_size"), no("s2_tail").alias("s2_tail"), F.coalesce(spread, F.lit(False)).alias("s3_tokens"), (no("s1_size") & ~no("_uneven")).alias("s4_degree"))


def _words(c: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), lambda w: w != ""))


def summary(checks: DataFrame) -> DataFrame:
    """check, facts, failures, passed: one row for each check; a leak or an s flag that is false is a failure."""
    flags = [c for c in checks.columns if c != "fact_id"]
    counts = checks.agg(F.count("*").alias("facts"), *[F.count_if(~F.col(c) if c.startswith("s") else F.col(c)).alias(c) for c in flags])
    return counts.unpivot("facts", flags, "check", "failures").select("check", "facts", "failures", (F.col("failures") == 0).alias("passed"))
