"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cell_ranks, cut, global_places, words_count

#: Rates are whole numbers of 1 / ONE, so that sums are exact and reruns agree.
ONE = 1 << 20


def source_key(source: Column) -> Column:
    """A text for each source, nulls too: "0" for null, else "1" and the source."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def shared_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sources (key, source, total) with target: share of all tokens, dealt by weights, at most `most` times a source's own.

    Sources in code-point order, null last, take the weights in turn. What a source may not take is dealt again by weight
    until none is above: one aggregate for each round, of which two sums come to the driver.
    """
    placed = global_places(sources, [F.col("source").isNull().asc(), F.col("source").asc()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    placed = cut(placed.withColumn("weight", weight).withColumn("cap", F.col("total") * F.lit(float(most))))
    total = placed.agg(F.sum("total")).first()[0] or 0
    goal, level, full = share * total, 0.0, -1
    while True:
        stopped = F.col("cap") <= F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        row = placed.agg(F.sum(F.when(stopped, F.col("total"))).alias("taken"), F.sum(F.when(~stopped, F.col("weight"))).alias("open"), F.count_if(stopped).alias("full")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (goal - most * (row["taken"] or 0)) / row["open"]
    return placed.select("key", "source", "total", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def balance(docs: DataFrame, targets: DataFrame, max_copies: int = 2, rounds: int = 60) -> DataFrame:
    """docs (key, size, any id columns; cut) with rate and copies, so that each key's taken tokens come to its target.

    The copies of a document are tilted exponentially from a base where each is taken once on average and `max_copies` at
    most: its rate is m / (1 + (m - 1) exp(-lambda size / mean)). That is the solution of least relative entropy whose
    expected tokens meet the constraint, and its dual is convex in lambda. Newton steps for all keys at once, kept in
    brackets, each aggregate a histogram of (key, size), whose rows grow with sizes and keys, not with documents; sums are
    whole numbers, so they don't hang on order. A target at or above max_copies times all tokens takes all that often.

    Rounding: a key's documents from long to short, and in the order of a hash within a size, take the whole steps of the
    running sum of rates. A document gets its rate rounded down or up, and a key misses its target by half of its longest
    document at most, besides the tolerance of the steps.
    """
    hist = cut(docs.groupBy("key", "size").agg(F.count("*").alias("n")))
    totals = hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs"))
    m = float(max_copies)
    state = totals.join(targets.select("key", F.col("target").cast("double").alias("target")), "key", "left").select(
        "key", F.coalesce("target", F.lit(0.0)).alias("target"), (m * F.col("total")).alias("limit"), F.greatest(F.col("total") / F.col("docs"), F.lit(1e-9)).alias("mean"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    edge = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("target") >= F.col("limit") * (1 - 1e-9), F.lit(m))
    state = cut(state.withColumn("fixed", edge).withColumn("done", edge.isNotNull()))
    rate = lambda: F.coalesce("fixed", F.lit(m) / (1 + F.lit(m - 1) * F.exp(-F.col("lam") * F.col("size") / F.col("mean"))))
    whole = lambda x: F.round(x * F.lit(float(ONE))).cast("decimal(38,0)")
    for _ in range(rounds):
        if not state.where(~F.col("done")).limit(1).count():
            break
        at = hist.join(state.where(~F.col("done")), "key").withColumn("r", rate())
        tokens = (F.col("n") * F.col("size")).cast("decimal(19,0)")
        sums = at.groupBy("key").agg(F.sum((tokens * whole(F.col("r"))).cast("decimal(38,0)")).alias("s"), F.sum((tokens * F.col("size") * whole(F.col("r") * (1 - F.col("r") / m))).cast("decimal(38,0)")).alias("d"))
        got = state.join(sums, "key", "left").withColumn("f", F.col("s").cast("double") / ONE).withColumn("slope", F.col("d").cast("double") / ONE / F.col("mean"))
        logit = lambda x: F.log(F.greatest(x, F.lit(1e-9)) / F.greatest(F.col("limit") - x, F.lit(1e-9)))
        got = got.withColumn("lo", F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + (logit(F.col("target")) - logit(F.col("f"))) * F.col("f") * (F.col("limit") - F.col("f")) / (F.col("limit") * F.greatest("slope", F.lit(1e-300)))
        far = F.when(F.col("f") < F.col("target"), F.greatest(2 * F.col("lam"), F.lit(1.0))).otherwise(F.least(2 * F.col("lam"), F.lit(-1.0)))
        ok = newton.isNotNull() & ~F.isnan(newton) & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        step = F.when(ok, newton).when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).otherwise(far)
        met = F.abs(F.col("f") - F.col("target")) <= F.greatest(F.lit(0.5), F.col("limit") * 2e-6)
        state = cut(got.select("key", "target", "limit", "mean", F.when(F.col("done") | met, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", "fixed", (F.col("done") | met).alias("done")))
    ends = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = hist.join(state.select("key", "lam", "mean", "fixed"), "key").withColumn("q", F.round(rate() * F.lit(float(ONE))).cast("long"))
    cells = cut(cells.select("key", "size", "q", F.coalesce(F.sum(F.col("n") * F.col("q")).over(ends), F.lit(0).cast("long")).alias("at")))
    ids = [c for c in docs.columns if c not in ("key", "size")]
    placed = cell_ranks(docs, ["key", "size"], F.struct(*[F.col(f"`{c}`") for c in ids]), "place").join(cells, ["key", "size"])
    upto = lambda k: F.shiftright(F.col("at") + (F.col("place") + k) * F.col("q") + ONE // 2, 20)
    return placed.withColumn("rate", F.col("q") / F.lit(float(ONE))).withColumn("copies", (upto(1) - upto(0)).cast("int")).drop("at", "q", "place")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, max_copies: int = 2, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix of whole documents: doc_id, source, size (words), source_size, target, rate, copies, taken (copies x size) and
    text_hash.

    Null texts have size 0; a null source is a source of its own, and comes last; documents of size 0 are taken by their
    rate and add nothing. Rows alike share out their copies; an empty table gives none; other columns are left out.
    """
    sized = cut(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), words_count(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash")).withColumn("key", source_key(F.col("source"))))
    sources = sized.groupBy("key").agg(F.sum("size").alias("total")).withColumn("source", F.when(F.col("key") != "0", F.expr("substring(key, 2)")))
    targets = cut(shared_targets(sources, weights, share, most))
    copies = balance(sized.select("doc_id", "key", "size", "text_hash"), targets, max_copies)
    out = copies.join(targets.select("key", "source", F.col("total").alias("source_size"), "target"), "key")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def repeat_rows(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with each row as often as the mix (of these docs) takes it.

    Rows are told apart by doc_id, source and text, nulls included. Rows alike in all three share out the sum of their copies
    as evenly as whole numbers can, in an order of all their columns; so the words taken are those of the mix.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # so that no name of docs clashes
    at = F.col("_row")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), source_key(F.col("source")))
    per = cut(mixed.groupBy(key.alias("_k"), F.col("text_hash").alias("_t")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0"))
    same = F.xxhash64(F.coalesce(at[doc_id].cast("long").cast("string"), F.lit("-")), source_key(at[source]))
    rows = own.join(per, (same == F.col("_k")) & (F.xxhash64(at[text].cast("string")) == F.col("_t")))
    times = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("_copy")
    out = rows.where("_rows = 1").select("_row", times(F.col("_copies")))
    if per.where("_rows > 1").limit(1).count():
        alike = cut(rows.where("_rows > 1").select("_row", "_k", "_t", "_copies", "_rows"))
        placed = cell_ranks(alike, ["_k", "_t"], F.to_json(F.struct("_row")), "_place")
        share = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_place") < F.pmod("_copies", "_rows")).cast("long")
        out = out.unionByName(placed.withColumn("_n", share).where("_n > 0").select("_row", times(F.col("_n"))))
    return out.select("_row.*")
