"""Statistics as aggregates: association, bootstrap, rank tests, corrections, intervals."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .facets import seeded
from .windows import average_rank, range_places, with_cells


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, levels and the bias-corrected V of two columns; null if a side has fewer than two levels.

    chi2 / n is sum(n_ij^2 / (row_i col_j)) - 1 over cells that occur, so empty cells needn't be made.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    wide = cells.withColumn("r", F.sum("n").over(Window.partitionBy(a))).withColumn("c", F.sum("n").over(Window.partitionBy(b)))
    t = wide.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))) - 1).alias("phi2"), F.countDistinct(a).alias("rows"), F.countDistinct(b).alias("cols"))
    less = (F.col("rows") - 1) * (F.col("cols") - 1) / (F.col("n") - 1)
    r = F.col("rows") - (F.col("rows") - 1) ** 2 / (F.col("n") - 1)
    c = F.col("cols") - (F.col("cols") - 1) ** 2 / (F.col("n") - 1)
    v = F.sqrt(F.greatest(F.lit(0.0), F.col("phi2") - less) / F.nullif(F.least(r, c) - 1, F.lit(0.0)))
    return t.select("n", "rows", "cols", F.round(F.when((F.col("rows") > 1) & (F.col("cols") > 1), v), 6).alias("v"))


def spearman(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    ranked = df.select(*by, average_rank(F.col(a), *by).alias("ra"), average_rank(F.col(b), *by).alias("rb"))
    return ranked.groupBy(*by).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def draws(values: DataFrame, ident: str, n: int, seed: str, by: list[str]) -> DataFrame:
    """by, draw and weight of each value in n bootstrap draws of a group: each of its places picks a place by hash.

    Each pick is a row of weight 1, so a draw is a sum and no draw is gathered: counts of picks would be about as many as
    the picks, in a table that a task has to hold. Picks are n times as many rows as their size is taken for, so the join is told
    to deal both sides out and to build the values' tables: else the picks might be broadcast, through the driver.
    """
    placed = range_places(values, by, ident, out="_i").withColumn("_i", F.col("_i") - 1).drop("_p")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"), F.lit(":"), F.col("_i").cast("string")), 256)
    number = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")
    picks = placed.select(*by, "_i", "_n").repartition(*by, "_i").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    picks = picks.select(*by, "draw", F.pmod(number, F.col("_n")).alias("_i"), F.lit(1).alias("weight"))
    return picks.join(placed.hint("shuffle_hash"), [*by, "_i"]).drop("_i", "_n")


def bootstrap(values: DataFrame, ident: str, value: str, by: list[str], n: int = 200, seed: str = "7", low: float = 0.025, high: float = 0.975, size: str | None = None) -> DataFrame:
    """by, mean, lo, hi of the mean (with `size`: of the ratio of sums of value and size, for clusters)."""
    d = draws(values, ident, n, seed, by)
    stat = lambda v, w: F.sum(F.col(v) * w) / (F.sum(F.col(size) * w) if size else F.sum(w))
    means = d.groupBy(*by, "draw").agg(stat(value, F.col("weight")).alias("m"))
    ends = means.groupBy(*by).agg(F.round(F.percentile("m", F.lit(low)), 6).alias("lo"), F.round(F.percentile("m", F.lit(high)), 6).alias("hi"))
    return values.groupBy(*by).agg(F.round(stat(value, F.lit(1.0)), 6).alias("mean")).join(ends, by)


def bootstrap_quantiles(values: DataFrame, ident: str, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95), n: int = 200, seed: str = "7", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """by, quantile, own, lo, hi: the interval of each quantile of the values; a draw's quantile counts a value by its weight."""
    each = lambda of: F.posexplode(of).alias("_k", "m")
    level = F.get(F.array(*[F.lit(float(a)) for a in at]), F.col("_k")).alias("quantile")
    of = lambda df, keys, *weight: df.groupBy(*keys).agg(F.percentile(value, list(map(float, at)), *weight).alias("q")).select(*keys, each("q")).select(*keys, level, "m")
    drawn = of(draws(values, ident, n, seed, by), [*by, "draw"], F.col("weight"))
    ends = drawn.groupBy(*by, "quantile").agg(F.round(F.percentile("m", F.lit(low)), 6).alias("lo"), F.round(F.percentile("m", F.lit(high)), 6).alias("hi"))
    return of(values, by).withColumn("own", F.round("m", 6)).drop("m").join(ends, [*by, "quantile"])


def equivalence(values: DataFrame, ident: str, value: str, by: list[str], sesoi: float, n: int = 200, seed: str = "7") -> DataFrame:
    """by, mean, lo, hi, equivalent: two one-sided tests, that is whether the mean's 90 % interval lies within +-sesoi."""
    b = bootstrap(values, ident, value, by, n, seed, 0.05, 0.95)
    return b.withColumn("equivalent", (F.col("lo") > -sesoi) & (F.col("hi") < sesoi))


def cluster_sign_flip(values: DataFrame, cluster: str, value: str, by: list[str], n: int = 200, seed: str = "11") -> DataFrame:
    """by, p: sign_flip of clusters' means, each mean whole and of one weight."""
    return sign_flip(values.groupBy(*by, cluster).agg(F.avg(value).alias(value)), cluster, value, by, n, seed)


def cluster_summary(values: DataFrame, cluster: str, value: str, by: list[str], n: int = 200, seed: str = "7") -> DataFrame:
    """by, mean, p, wins, ties, losses of clusters weighted by their sizes: p is twice the lesser share of bootstrap draws of
    whole clusters at or below, or at or above, 0; wins are clusters whose mean is over 0."""
    c = values.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_z"))
    m = draws(c, cluster, n, seed, by).groupBy(*by, "draw").agg(F.round(F.sum(F.col("_s") * F.col("weight")) / F.sum(F.col("_z") * F.col("weight")), 9).alias("m"))
    p = m.groupBy(*by).agg(F.least(F.lit(1.0), 2.0 * F.least(F.count_if(F.col("m") <= 0), F.count_if(F.col("m") >= 0)) / n).alias("p"))
    own = c.groupBy(*by).agg(F.round(F.sum("_s") / F.sum("_z"), 6).alias("mean"), F.count_if(F.col("_s") > 0).alias("wins"), F.count_if(F.col("_s") == 0).alias("ties"), F.count_if(F.col("_s") < 0).alias("losses"))
    return own.join(p, by)


def sign_flip(values: DataFrame, ident: str, value: str, by: list[str], n: int = 200, seed: str = "11") -> DataFrame:
    """by, p: (draws whose flipped mean is at least as far from 0, plus 1) / (n + 1)."""
    rows = values.repartition(ident).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sign = F.when(seeded(seed, "draw", ident) < "8", 1.0).otherwise(-1.0)  # by its first digit
    flipped = rows.groupBy(*by, "draw").agg(F.round(F.abs(F.avg(F.col(value) * sign)), 9).alias("m"))
    own = values.groupBy(*by).agg(F.round(F.abs(F.avg(value)), 9).alias("own"))
    return flipped.join(own, by).groupBy(*by).agg(F.round((F.count_if(F.col("m") >= F.col("own")) + 1) / F.lit(n + 1.0), 9).alias("p"))


def shuffle_null(values: DataFrame, ident: str, value: str, by: list[str], n: int = 200, seed: str = "11") -> DataFrame:
    """by, mean, p, z: the mean against those of n random sign flips; p has one added to both counts, z is the distance from
    their mean in their standard deviations."""
    rows = values.repartition(ident).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sign = F.when(seeded(seed, "draw", ident) < "8", 1.0).otherwise(-1.0)  # by its first digit
    flipped = rows.groupBy(*by, "draw").agg(F.round(F.avg(F.col(value) * sign), 9).alias("m"))
    own = values.groupBy(*by).agg(F.round(F.avg(value), 9).alias("mean"))
    every = flipped.join(own, by).groupBy(*by, "mean")
    return every.agg(F.round((F.count_if(F.col("m") >= F.col("mean")) + 1) / F.lit(n + 1.0), 9).alias("p"), F.round((F.col("mean") - F.avg("m")) / F.stddev_samp("m"), 5).alias("z"))


def wilcoxon(pairs: DataFrame, diff: str, by: list[str], least: int = 3, when_few: float | None = None) -> DataFrame:
    """by, n, w_plus, p: signed ranks by the normal approximation, without corrections; under `least` differences p is when_few."""
    rows = pairs.where(F.col(diff) != 0).withColumn("_abs", F.abs(F.col(diff)))
    ranked = rows.withColumn("_r", average_rank(F.col("_abs"), *by))
    t = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"))
    z = (F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24)
    return t.withColumn("z", z).select(*by, "n", "w_plus", F.round(F.when(F.col("n") >= least, erfc(F.abs("z") / math.sqrt(2))).otherwise(F.lit(when_few)), 6).alias("p"))


# The coefficients of a Chebyshev fit to the complementary error function, from the constant term on.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to a relative error of 1.2e-7, in built-in functions."""
    t = 1 / (1 + x / 2)
    power = F.lit(0.0)
    for c in reversed(ERFC):
        power = power * t + F.lit(c)
    return t * F.exp(power - x * x)


#: Differences up to which the exact distribution of signed ranks is used; its counts are below 2^50 and exact in a double.
EXACT = 50


def signed_rank_table(sizes: DataFrame) -> DataFrame:
    """n, below: for each n (EXACT at most) the number of subsets of the ranks 1 to n whose sum is at most s, for s from 0.

    Rank by rank, counts are added to themselves moved up by the rank: a fold over arrays within the plan.
    """
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), F.array(F.lit(1.0)), lambda acc, r: F.zip_with(F.concat(acc, zeros(r)), F.concat(zeros(r), acc), lambda x, y: x + y))
    run = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x))
    return sizes.select("n", ways.alias("w")).select("n", F.aggregate("w", F.array().cast("array<double>"), run).alias("below"))


def wilcoxon_exact(pairs: DataFrame, diff: str, by: list[str]) -> DataFrame:
    """by, n, w_plus, exact, p: signed ranks of differences other than 0; two-sided p of the exact distribution where there are
    EXACT differences at most and no ties among them, of the normal approximation else."""
    rows = pairs.where(F.col(diff) != 0)
    ties = rows.groupBy(*by).agg((F.count("*") == F.count_distinct(F.abs(F.col(diff)))).alias("free"))
    t = wilcoxon(pairs, diff, by, least=1).join(ties, by)
    small = (F.col("n") <= EXACT) & F.col("free")
    table = signed_rank_table(t.where(small).select("n").distinct()).withColumnRenamed("n", "_n")  # a row for each n
    both = t.withColumn("exact", small).join(F.broadcast(table), (F.col("n") == F.col("_n")) & F.col("exact"), "left")
    low = F.least("w_plus", F.col("n") * (F.col("n") + 1) / 2 - F.col("w_plus")).cast("int")
    p = F.least(F.lit(1.0), 2 * F.element_at("below", low + 1) / F.pow(F.lit(2.0), F.col("n")))
    return both.select(*by, "n", "w_plus", "exact", F.round(F.when(F.col("exact"), p).otherwise(F.col("p")), 6).alias("p"))


def paired_accuracy(outcomes: DataFrame, item: str, condition: str, hit: str, first: str, second: str, by: list[str]) -> DataFrame:
    """by, n, first, second, diff, gained, lost, p: accuracies of two conditions on the items that have both, by stratum.

    hit is 0 or 1; gained (lost) counts items that only the second (the first) has right, and p is the exact two-sided sign
    test of these: 2 P(X <= min) of a fair coin tossed gained + lost times, for
    1,000 tosses at most, and its normal approximation with a correction of one half each way beyond.
    """
    side = lambda c, name: F.max(F.when(F.col(condition) == c, F.col(hit))).alias(name)
    wide = outcomes.where(F.col(condition).isin(first, second)).groupBy(*by, item).agg(side(first, "a"), side(second, "b")).where("a IS NOT NULL AND b IS NOT NULL")
    sums = wide.groupBy(*by).agg(F.count("*").alias("n"), F.avg("a").alias("first"), F.avg("b").alias("second"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("gained"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("lost"))
    m, k = F.col("gained") + F.col("lost"), F.least("gained", "lost")
    # terms of the binomial from the first on, each from the one before: C(m, i + 1) = C(m, i) (m - i) / (i + 1)
    start = F.struct(F.pow(F.lit(2.0), -m).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] * (m - i) / (i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step)["sum"]
    normal = erfc(F.greatest(F.abs(F.col("gained") - F.col("lost")) - 1, F.lit(0)) / F.sqrt(m) / math.sqrt(2))
    p = F.when(m == 0, 1.0).when(m <= 1000, F.least(F.lit(1.0), 2 * tail)).otherwise(normal)
    return sums.select(*by, "n", F.round("first", 9).alias("first"), F.round("second", 9).alias("second"), F.round(F.col("second") - F.col("first"), 9).alias("diff"), "gained", "lost", F.round(p, 6).alias("p"))


def holm(df: DataFrame, p: str, by: list[str], ident: str) -> DataFrame:
    """df with p_holm: step-down, the greatest so far of (m - i + 1) p, at most 1."""
    rows = range_places(df, by, p, ident).withColumn("_x", (F.col("_n") - F.col("_r") + 1) * F.col(p))
    return _so_far(rows, by, F.max, F.col("_r"), F.col("_p")).withColumn("p_holm", F.round(F.least(F.lit(1.0), "_y"), 9)).drop("_x", "_y", "_r", "_n", "_p")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], ident: str) -> DataFrame:
    """df with p_bh: step-up, the least from here on of m p / i, at most 1."""
    rows = range_places(df, by, p, ident).withColumn("_x", F.col("_n") * F.col(p) / F.col("_r"))
    return _so_far(rows, by, F.min, F.desc("_r"), F.desc("_p")).withColumn("p_bh", F.round(F.least(F.lit(1.0), "_y"), 9)).drop("_x", "_y", "_r", "_n", "_p")


def _so_far(rows: DataFrame, by: list[str], best: Callable, place: Column, part: Column) -> DataFrame:
    """rows with _y: the best _x up to here in the order of places, within ranges and over the ranges before; a frame that runs on
    from the current row to the end would be summed up anew for each row."""
    before = best("_b").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    cells = rows.groupBy(*by, "_p").agg(best("_x").alias("_b")).select(*by, "_p", before.alias("_b"))
    own = best("_x").over(Window.partitionBy(*by, "_p").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    of = F.greatest if best is F.max else F.least
    return with_cells(rows.withColumn("_y", own), cells, [*by, "_p"]).withColumn("_y", of("_y", "_b")).drop("_b")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.round(mid - half, 9), F.round(mid + half, 9)


def wasserstein(df: DataFrame, a: str, b: str) -> DataFrame:
    """The area between the two columns' distribution functions, whatever the numbers of their values; nulls are left out.

    Values are put in 64 ranges by their quantiles. A range is summed up in a task of its own, from the counts before it,
    of which one row for each range comes to the driver.
    """
    side = lambda c, x, y: df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"), F.lit(x).alias("na"), F.lit(y).alias("nb"))
    rows = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    edges = sorted(set(rows.approxQuantile("x", [k / 64 for k in range(1, 64)], 0.005)))
    cell = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("x"))) if edges else F.lit(0)
    rows = rows.withColumn("cell", cell)
    heads = sorted(rows.groupBy("cell").agg(F.sum("na"), F.sum("nb"), F.min("x")).collect())
    before, a_sum, b_sum = {}, 0, 0
    for k, (c, na, nb, _) in enumerate(heads):
        before[c] = (a_sum, b_sum, heads[k + 1][3] if k + 1 < len(heads) else None)
        a_sum, b_sum = a_sum + na, b_sum + nb
    if not a_sum or not b_sum:
        return df.sparkSession.createDataFrame([(None,)], "w1 double")
    known = df.sparkSession.createDataFrame([(c, *map(float, v[:2]), v[2]) for c, v in before.items()], "cell int, a0 double, b0 double, next double")
    w = Window.partitionBy("cell").orderBy("x")
    steps = rows.join(F.broadcast(known), "cell").select(  # 64 rows
        ((F.col("a0") + F.sum("na").over(w)) / a_sum - (F.col("b0") + F.sum("nb").over(w)) / b_sum).alias("gap"), (F.coalesce(F.lead("x").over(w), F.col("next")) - F.col("x")).alias("wide"))
    return steps.agg(F.round(F.coalesce(F.sum(F.abs("gap") * F.col("wide")), F.lit(0.0)), 6).alias("w1"))


def icc1(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way intraclass correlation of a value by group, in closed form from group sums."""
    g = df.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    t = g.agg(F.count("*").cast("double").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"), F.sum(F.col("n") ** 2).alias("n2"))
    between = (F.col("b") - F.col("s") ** 2 / F.col("n")) / (F.col("k") - 1)
    within = (F.col("ss") - F.col("b")) / (F.col("n") - F.col("k"))
    n0 = (F.col("n") - F.col("n2") / F.col("n")) / (F.col("k") - 1)
    return t.select(F.round((between - within) / (between + (n0 - 1) * within), 6).alias("icc"))


def paired_sample_size(rate: Column, delta: Column, design: Column, alpha_z: float = 1.959963984540054, power_z: float = 0.8416212335729143) -> Column:
    """Items for a paired test of proportions: discordance `rate`, difference `delta`, times the design effect."""
    n = (alpha_z * F.sqrt(rate) + power_z * F.sqrt(rate - delta * delta)) ** 2 / (delta * delta)
    return F.ceil(n * design).cast("bigint")


def observed_sample_size(pairs: DataFrame, stratum: str, cluster: str, a: str, b: str, within: float) -> DataFrame:
    """stratum, pairs, rate, delta, design, n of paired 0/1 outcomes a and b: pairs that a later test needs to show delta.

    rate: the share of pairs that disagree; delta: the difference of both shares; design: 1 + (size - 1) x within, where size
    is the mean cluster size that a pair sees. Clusters are summed up first, so a stratum of any size is a partial aggregate.
    A stratum without a difference has no row; pairs with a null outcome don't count.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    c = rows.groupBy(stratum, cluster).agg(F.count("*").alias("_m"), F.sum((F.col(a) != F.col(b)).cast("int")).alias("_x"), F.sum(F.col(a) - F.col(b)).alias("_y"))
    n = F.sum("_m")
    g = c.groupBy(stratum).agg(n.alias("pairs"), (F.sum("_x") / n).alias("rate"), (F.abs(F.sum("_y")) / n).alias("delta"), (1 + (F.sum(F.col("_m") * F.col("_m")) / n - 1) * within).alias("design"))
    size = paired_sample_size(F.col("rate"), F.col("delta"), F.col("design"))
    return g.where("delta > 0").select(stratum, "pairs", *[F.round(x, 9).alias(x) for x in ("rate", "delta", "design")], size.alias("n"))
