"""Ranks, bins, gaps, samples and folds by windows and by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from .facets import seeded


def average_rank(value: Column, *by: str) -> Column:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def terciles(order: list[Column], *by: str) -> Column:
    """low, mid, high by place, ties by the given order: of n = 3 k + r rows, low takes k and one more if r is 2 ... as
    quantile cuts of places do, with 1 + one more of r = 1 going to low."""
    n = F.count("*").over(Window.partitionBy(*by))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    pos = (r - 1) * 3
    return F.when(pos <= n - 1, "low").when(pos <= 2 * (n - 1), "mid").otherwise("high")


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """One row for each group, the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def middle_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The row at place floor(n / 2), from 0, of each group."""
    w = Window.partitionBy(*by)
    return df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).where("_r - 1 = floor(_n / 2)").drop("_r", "_n")


def first_n(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def suffixed(name: Column, *order: Column) -> Column:
    """A name, and name_2, name_3 for its repeats in order."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return F.when(r == 1, name).otherwise(F.concat(name, F.lit("_"), r.cast("string")))


def sample_per_group(df: DataFrame, by: list[str], n: int, ident: str, seed: str) -> DataFrame:
    return first_n(df, by, n, seeded(seed, ident), F.col(ident))


def hash_places(df: DataFrame, ident: str, seed: str, by: list[str], out: str = "_r") -> DataFrame:
    """df with `out`, each row's place from 1 by a hash of `ident` in its group of `by` (none: among all rows), and `_n`, the
    group's rows.

    A group of any size is dealt out by the first three digits of the hash: 4,096 cells at most, whose counts give the
    offsets, so that no group is sorted in one task. Rows with one ident lie in one cell; their order is open.
    """
    rows = df.withColumn("_h", seeded(seed, ident)).withColumn("_c", F.substring("_h", 1, 3))
    cells = rows.groupBy(*by, "_c").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by)
    above = F.coalesce(F.sum("_k").over(w.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_c").alias("_cell"), above.alias("_above"), F.sum("_k").over(w).alias("_n"))
    same = F.col("_c") == F.col("_cell")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    place = F.row_number().over(Window.partitionBy(*by, "_c").orderBy("_h", ident))
    placed = rows.withColumn(out, place).join(cells, same).withColumn(out, F.col(out) + F.col("_above"))
    return placed.drop("_h", "_c", "_cell", "_above", *[f"_by{i}" for i in range(len(by))])


def range_places(df: DataFrame, by: list[str], *order: str, out: str = "_r") -> DataFrame:
    """df with `out`, each row's place from 1 by the columns `order` in its group of `by`, `_n`, the group's rows, and `_p`, the
    range it lies in: places rise with ranges.

    Rows are dealt out by ranges of group and order, stored, and ranked within a range and group; counts of these give the
    offsets, so a group of any size is sorted in many tasks.
    """
    rows = stored(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    cells = rows.groupBy(*by, "_p").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by)
    above = F.coalesce(F.sum("_k").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(*by, "_p", above.alias("_above"), F.sum("_k").over(w).alias("_n"))
    placed = rows.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)))
    return with_cells(placed, cells, [*by, "_p"]).withColumn(out, F.col(out) + F.col("_above")).drop("_above")


def with_cells(df: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """df with the other columns of its row of cells; nulls in `on` meet nulls."""
    few = cells.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in cells.columns if c not in on])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return df.join(few, same).drop(*[f"_on{i}" for i in range(len(on))])


def folds(df: DataFrame, value: str, k: int, seed: str, *by: str) -> DataFrame:
    """value, fold of the distinct values: their places by a hash, modulo k, so folds are even and runs agree."""
    placed = hash_places(df.select(*by, value).distinct(), value, seed, list(by))
    return placed.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r", "_n")


def split(df: DataFrame, ident: str, by: list[str], share: float, seed: str) -> DataFrame:
    """Each group's first share (rounded down, one at least, and one left for the rest) by hash as "dev", the rest "holdout"."""
    take = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * share), F.col("_n") - 1))
    return hash_places(df, ident, seed, by).withColumn("split", F.when(F.col("_r") <= take, "dev").otherwise("holdout")).drop("_r", "_n")


def gaps(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """by, n, p50, p95 of seconds between neighbours; p95 is the sorted gap at floor(0.95 (n - 1)), not interpolated."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.select(*by, ((micros - F.lag(micros).over(Window.partitionBy(*by).orderBy(time))) / 1e6).alias("gap")).where("gap IS NOT NULL")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("gap")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("p50"), F.max(F.when(F.col("_r") == F.floor(F.lit(0.95) * (F.col("_n") - 1)), F.col("gap"))).alias("p95"))


def valid_depth(ranking: DataFrame, mask: DataFrame, need: int, k: int) -> DataFrame:
    """query_id, depth (rank of the need-th valid item, null if there are fewer), valid_at_k."""
    rows = ranking.join(mask.select("query_id", "item_id", F.lit(1).alias("ok")), ["query_id", "item_id"], "left")
    seen = F.count("ok").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_seen", seen)
    return rows.groupBy("query_id").agg(F.min(F.when((F.col("_seen") == need) & (F.col("ok") == 1), F.col("rank"))).alias("depth"), F.count(F.when(F.col("rank") <= k, F.col("ok"))).alias("valid_at_k"))


def even_sample(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """Rows of each group at n evenly spaced places (halves to even, repeats once)."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("int"))
    return rows.where(F.array_contains(F.when(F.col("_n") <= n, F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).otherwise(places), F.col("_r"))).drop("_r", "_n")


def derange(df: DataFrame, ident: str, value: str, seed: str, by: list[str]) -> DataFrame:
    """Each row gets another row's value: the next in the order of a hash, the last one the first's, within a group."""
    w = Window.partitionBy(*by).orderBy(seeded(seed, ident), ident)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(f"other_{value}", F.coalesce(F.lead(value).over(w), first))


def islands(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """by, start, end of the unions of overlapping or touching spans: gaps and islands."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where(F.col(start) < F.col(end)).withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    rows = rows.withColumn("_g", F.sum("_new").over(w))
    return rows.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def span_scores(gold: DataFrame, found: DataFrame, by: list[str], enough: float = 0.95) -> DataFrame:
    """by, gold_len, found_len, shared, coverage, precision, f1, sufficient of unions of spans; 0 where nothing is found."""
    g, f = islands(gold, by), islands(found, by)
    length = lambda df, n: df.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    both = g.join(f.select(*by, F.col("start").alias("s"), F.col("end").alias("e")), by).where("s < end AND start < e")
    shared = both.groupBy(*by).agg(F.sum(F.least("end", "e") - F.greatest("start", "s")).alias("shared"))
    wide = length(g, "gold_len").join(length(f, "found_len"), by, "left").join(shared, by, "left").na.fill(0, ["found_len", "shared"])
    c, p = F.col("shared") / F.col("gold_len"), F.when(F.col("found_len") > 0, F.col("shared") / F.col("found_len")).otherwise(0.0)
    return wide.withColumn("coverage", F.round(c, 9)).withColumn("precision", F.round(p, 9)).withColumn("f1", F.round(F.when(c + p > 0, 2 * c * p / (c + p)).otherwise(0.0), 9)).withColumn("sufficient", c >= enough)


def pack_budget(df: DataFrame, by: str, size: str, ident: str, budget: int, *order: Column) -> DataFrame:
    """by, picked (ids in order): greedily what still fits, in order, and the first if nothing does.

    What fits hangs on what was taken, so it is a fold over a group's bounded list of candidates, not a prefix sum.
    """
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(size).cast("bigint").alias("n"), F.col(ident).alias("i")))).alias("l"))
    kind = df.schema[ident].dataType.simpleString()
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))
    fits = lambda a, x: a["used"] + x["n"] <= budget
    step = lambda a, x: F.struct(F.when(fits(a, x), a["used"] + x["n"]).otherwise(a["used"]).alias("used"), F.when(fits(a, x), F.concat(a["ids"], F.array(x["i"]))).otherwise(a["ids"]).alias("ids"))
    folded = lists.select(by, "l", F.aggregate("l", start, step).alias("f"))
    return folded.select(by, F.when(F.size("f.ids") == 0, F.array(F.get("l", F.lit(0))["i"])).otherwise(F.col("f.ids")).alias("picked"))
